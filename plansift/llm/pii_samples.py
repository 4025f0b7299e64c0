"""Labelled training windows for the character tagger, written by rule.

A window is filler prose with spans of personal data in usual and unusual
forms, and with things that look like them and are not: dates, prices,
versions, keys and hexadecimal strings.
"""

from __future__ import annotations

import numpy as np

from plansift.llm.pii import SIGN, codes

_VOWELS, _OTHERS = "aeiouäöüéèíóú", "bcdfghjklmnprstvwz"
#: Common words, among them those that spell an address.
_COMMON = (
    "the of and to in is that at at at for it on was with as be dot point dot write please now here meet look arrive at home noon once least from this are by an not we you they have his her "
    "der die und das ist von mit auf nicht ein eine sich des dem im zu den für le la les de des et un une que est pour dans sur pas el los las y en que por con una no se del "
    "version license under number call mail email phone card host server address contact reply"
).split()


def _word(r: np.random.Generator) -> str:
    x = r.random()
    if x < 0.3:
        w = _COMMON[r.integers(len(_COMMON))]
    elif x < 0.55:
        w = "".join(_OTHERS[r.integers(len(_OTHERS))] + _VOWELS[r.integers(5 if r.random() < 0.8 else len(_VOWELS))] for _ in range(r.integers(1, 5)))
    else:
        w = _plain(r, 2, 14)
    if r.random() < 0.15:  # signs within words are none
        k = int(r.integers(0, len(w) + 1))
        w = w[:k] + _pick(r, "at", "at", "dot") + (w[k:] or _plain(r, 1, 4))
    x = r.random()
    return w.capitalize() if x < 0.12 else w.upper() if x < 0.16 else w


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(str(d) for d in r.integers(0, 10, n))


def _pick(r: np.random.Generator, *options: str) -> str:
    return options[r.integers(len(options))]


def _plain(r: np.random.Generator, least: int, most: int) -> str:
    return "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(least, most)))


def _email(r: np.random.Generator) -> str:
    # names are words like any other: only what stands beside them tells an address
    name = "".join(c for c in _word(r) if c.isascii()) + _plain(r, 1, 4) if r.random() < 0.85 else _plain(r, 20, 70)
    if r.random() < 0.7:
        name += _pick(r, ".", "_", "-", ".") + (_plain(r, 2, 7) if r.random() < 0.5 else _digits(r, 2))
    at = _pick(r, "@", "@", "@", "@", " at ", " at ", " (at) ", "[at]", " [at] ", "(at)", " @ ", "{at}", " [ at ] ")
    dot = "." if r.random() < (0.85 if "@" in at else 0.4) else _pick(r, " dot ", "[dot]", " (dot) ", "(dot)", " [dot] ", " [ dot ] ")
    end = _pick(r, "com", "com", "org", "net", "de", "fr", "es", "edu", "io", "info")
    return name + at + dot.join([_plain(r, 3, 9) + (_digits(r, 1) if r.random() < 0.3 else ""), *([_plain(r, 4, 8)] if r.random() < 0.5 else []), end])


def _ip(r: np.random.Generator) -> str:
    return _pick(r, ".", ".", ".", "[.]", " dot ", "(dot)", " . ").join(str(x) for x in r.integers(0, 256, 4))


def _card(r: np.random.Generator) -> str:
    d = _pick(r, "4", "5", "37", "6")
    d += _digits(r, 15 - len(d))
    total = sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(d)))
    d += str(-total % 10)
    return _pick(r, "", "", " ", "-", ".", "  ", "/").join(d[k : k + 4] for k in range(0, 16, 4))


def _phone(r: np.random.Generator) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return _pick(r, f"+1 ({a}) {b}-{c}", f"+{r.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{r.integers(10, 99)} {a} {b}{c}", f"0{a}/{b} {c}", f"+{r.integers(1, 99)}-{a}-{b}-{c}")


def _other(r: np.random.Generator) -> str:
    return _pick(
        r, f"{r.integers(1990, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", f"{r.integers(1, 29)}.{r.integers(1, 13)}.{r.integers(1990, 2030)}", f"{r.integers(0, 24)}:{r.integers(0, 60):02d}",
        f"v{r.integers(0, 20)}.{r.integers(0, 20)}.{r.integers(0, 20)}", f"{r.integers(0, 2000)}.{r.integers(10, 99)}", _digits(r, r.integers(1, 8)), "AKIA" + _plain(r, 8, 15).upper() + _digits(r, 2),
        "token = \"" + "".join("0123456789abcdef"[k] for k in r.integers(0, 16, 32)) + "\"", "password=" + "".join("0123456789abcdef"[k] for k in r.integers(0, 16, 16)), f"{r.integers(0, 100)}%",
        f"Licensed under the Apache License, Version {r.integers(1, 4)}.0.", f"License, version {r.integers(1, 4)}. ", "CC BY-NC 4.0.", "version 2 of the License", f"section {r.integers(1, 9)}.{r.integers(1, 30)}",
        f"{_word(r)} at {_word(r)} dot {_word(r)}", f"{_word(r)} at {_word(r)} dot {_word(r)}", f"{_word(r)} at {_word(r)}. {_word(r)}", f"{_word(r)} at {_word(r)}", f"at {_word(r)}. {_word(r).capitalize()}", f"looked at {_word(r)}, {_word(r)}. {_word(r)}", f"http://{_plain(r, 4, 9)}.com/{_digits(r, 3)}", f"www.{_plain(r, 4, 9)}.org", f"at {r.integers(1, 12)} pm",
        f"at www.{_plain(r, 4, 9)}.com", f"@{_plain(r, 4, 9)} {_word(r)}", f"a dot on the {_word(r)}",
    )


_MAKERS = (_email, _ip, _card, _phone)


def sample(rng: np.random.Generator, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of one window cut from a longer line at a random place; half of the lines hold no personal data."""
    text, tags = "", []
    some = 0.3 * float(rng.random() < 0.6)
    while len(text) < 2 * width:
        x = rng.random()
        kind = int(rng.choice(len(_MAKERS), p=(0.55, 0.15, 0.15, 0.15))) if x < some else -1
        part = _MAKERS[kind](rng) if kind >= 0 else _other(rng) if x < some + 0.12 else _word(rng)
        text += part
        tags += [2 * kind + 1] + [2 * kind + 2] * (len(part) - 1) if kind >= 0 else [0] * len(part)
        gap = _pick(rng, " ", " ", " ", " ", " ", " ", " ", ", ", ". ", "\n", ": ", "!! ", "### ", ".\n", "%%% ", "&&& ", "*** ", "$$$ ")
        text += gap
        tags += [0] * len(gap)
    at = int(rng.integers(0, len(text) - width + 1))
    own, told = text[at : at + width], np.array(tags[at : at + width])
    if rng.random() < 0.5:
        # as the last window of a stretch, which ends with a word
        own = own[: max(own.rfind(" "), 1)]
        chars = np.zeros(width, dtype=np.int64)
        chars[: len(own)] = codes(own)
        told[len(own) :] = 0
    else:
        chars = codes(own)
    # a span that the window cuts before its sign can't be told from other words
    for edge in (slice(None), slice(None, None, -1)):
        end = told[edge][: len(own)] if edge.step is None else told[: len(own)][edge]
        n = 0
        while n < len(end) and end[n]:
            n += 1
        part = own[:n] if edge.step is None else own[len(own) - n :]
        if n and not any(c.isdigit() for c in part) and not SIGN.search(part):
            told[: len(own)][edge][:n] = 0
    return chars, told
