"""Personal data by fixed patterns and a character-level BiLSTM with a CRF.

The patterns (:func:`base_spans`) find what is written in the usual forms. A
small bidirectional LSTM over characters, with transitions between tags as in
a conditional random field, is trained in numpy from labelled spans that
:mod:`plansift.llm.pii_samples` writes; it finds what is written otherwise, as
in ``name (at) host (dot) org``. Its emissions are computed for overlapping
windows; where windows overlap they are averaged, weighted to the windows'
middles, one best path is decoded for the whole stretch, and of its spans those
stay whose tags outscore none by enough.

The model reads the surroundings of every digit, ``@`` and word ``at`` or
``dot``, of which each of the forms it is trained on holds one: so many
characters on either side and on to the ends of the words there, however long.
A span that it tags is widened to whole words and kept if its values can be
what its kind is: numbers up to 255, a right checksum, a name and a host
(:func:`valid`); the form is the model's decision.

Defined cases: null counts as the empty text; an empty text has no spans and
the digest of the empty string; rows that repeat an id give a row each; an
empty table gives no rows; extra columns are never read. Long texts are read
whole, some windows at a time.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from plansift.llm.rows import identified, map_columns

# Kinds in order, and the patterns of their usual forms.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: How ``@`` and a full stop are written out.
AT = re.compile(r"@|\W(?:at)\W", re.I)
STOP = re.compile(r"(?<=\w)\.(?=\w)|\W(?:dot)\W|\s\.\s", re.I)
DIGIT = re.compile(r"[0-9]")
SPACE = re.compile(r"\s")
NUMBER = re.compile(r"[0-9]+")
DIGITS = frozenset("0123456789")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    """The checksum of card numbers: from the right, every second digit is doubled."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from each ``@``: the characters before it, and the name after it, in one pass."""
    out: list[Span] = []
    free = 0  # nothing before this is used again
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start; matches that fail their test are dropped."""
    out = _emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# ---------------------------------------------------------------- the model

#: Characters of a window, and between the starts of two.
WINDOW, STRIDE = 64, 32
#: Characters that are read on either side of a sign of personal data.
MARGIN = 40
SIGN = re.compile(r"[0-9@]|\b(?:at|dot)\b", re.I)
EMBED, HIDDEN = 12, 16
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind
#: By how much the tags of a span must outscore none, a character on average.
SURE = 0.4
#: Windows that go through the model at once.
AT_ONCE = 1024


def codes(text: str) -> np.ndarray:
    """Printable ASCII characters by number; others as letters, spaces or the rest."""
    if text.isascii():
        raw = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(np.int64)
        return np.where((raw >= 32) & (raw < 127), raw - 31, 97)
    return np.array([ord(c) - 31 if 32 <= ord(c) < 127 else 96 if c.isalpha() else 97 if c.isspace() else 98 for c in text], dtype=np.int64)


ALPHABET = 99  # 0 is padding


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Tagger:
    """Embedding, two LSTMs, a linear layer and transitions; arrays by name in ``p``."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        p = {"embed": r.normal(0, 0.3, (ALPHABET, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "lr":
            p[d + "x"] = r.normal(0, 1 / np.sqrt(EMBED), (EMBED, 4 * HIDDEN))
            p[d + "h"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)) * 0.7
            p[d + "b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States over time for ``x`` (time, batch, embed); gates too if they are kept for training."""
        t, b, _ = x.shape
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        given = x @ self.p[d + "x"] + self.p[d + "b"]
        out, kept = np.empty((t, b, HIDDEN), np.float32), []
        for k in range(t) if d == "l" else range(t - 1, -1, -1):
            z = given[k] + h @ self.p[d + "h"]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 3 * HIDDEN :])
            g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            before_h, before_c = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[k] = h
            if keep:
                kept.append((k, i, f, g, o, s, before_h, before_c))
        return out, kept

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Scores of tags for windows of codes (batch, time): (batch, time, tags)."""
        x = self.p["embed"][chars.T]
        both = np.concatenate([self._lstm(x, "l", False)[0], self._lstm(x, "r", False)[0]], axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def gradient(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of tag paths, and its gradient."""
        p, (b, t) = self.p, chars.shape
        x = p["embed"][chars.T]
        left, kept_l = self._lstm(x, "l", True)
        right, kept_r = self._lstm(x, "r", True)
        both = np.concatenate([left, right], axis=2)
        e = (both @ p["out"] + p["bias"]).astype(np.float64)
        move, first = p["move"].astype(np.float64), p["first"].astype(np.float64)
        # forward and backward sums of the paths' weights
        a = np.empty((t, b, TAGS))
        a[0] = first + e[0]
        for k in range(1, t):
            a[k] = _log_sum(a[k - 1][:, :, None] + move, 1) + e[k]
        z = _log_sum(a[-1], 1)
        back = np.zeros((t, b, TAGS))
        pairs = np.zeros((TAGS, TAGS))
        for k in range(t - 2, -1, -1):
            ahead = (e[k + 1] + back[k + 1])[:, None, :] + move
            back[k] = _log_sum(ahead, 2)
            pairs += np.exp(a[k][:, :, None] + ahead - z[:, None, None]).sum(0)
        share = np.exp(a + back - z[None, :, None])
        y = tags.T
        rows = np.arange(b)
        score = first[y[0]] + sum(e[k][rows, y[k]] for k in range(t)) + sum(move[y[k - 1], y[k]] for k in range(1, t))
        de = share
        de[np.arange(t)[:, None], rows[None, :], y] -= 1
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
        scale = 1.0 / b
        g = {"move": (pairs - seen) * scale, "first": de[0].sum(0) * scale}
        de = (de * scale).astype(np.float32)
        g["out"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        g["bias"] = de.sum((0, 1))
        dboth = de @ p["out"].T
        dx = np.zeros_like(x)
        for d, kept, dh_all in (("l", kept_l, dboth[:, :, :HIDDEN]), ("r", kept_r, dboth[:, :, HIDDEN:])):
            dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
            gx, gh, gb = np.zeros_like(p[d + "x"]), np.zeros_like(p[d + "h"]), np.zeros_like(p[d + "b"])
            for k, i, f, gg, o, s, h0, c0 in reversed(kept):
                dh = dh + dh_all[k]
                dc = dc + dh * o * (1 - s * s)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - gg * gg), dh * s * o * (1 - o)], axis=1)
                gx += x[k].T @ dz
                gh += h0.T @ dz
                gb += dz.sum(0)
                dx[k] += dz @ p[d + "x"].T
                dh = dz @ p[d + "h"].T
                dc = dc * f
            g[d + "x"], g[d + "h"], g[d + "b"] = gx, gh, gb
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, chars.T.ravel(), dx.reshape(-1, EMBED))
        g["embed"] = embed
        return float((z - score).mean()), g

    def best_paths(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The best tags of stretches (batch, time, tags), padded beyond their lengths."""
        b, t, _ = scores.shape
        move = self.p["move"]
        best = self.p["first"] + scores[:, 0]
        came = np.zeros((t, b, TAGS), dtype=np.int8)
        for k in range(1, t):
            ways = best[:, :, None] + move
            came[k] = ways.argmax(1)
            on = ways.max(1) + scores[:, k]
            live = (k < lengths)[:, None]
            best = np.where(live, on, best)
        out = []
        for row in range(b):
            n = int(lengths[row])
            path = np.empty(n, dtype=np.int64)
            path[-1] = best[row].argmax()
            for k in range(n - 1, 0, -1):
                path[k - 1] = came[k, row, path[k]]
            out.append(path)
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


#: The arrays of a tagger that :func:`trained` fitted, written by ``python -m plansift.llm.pii``.
FITTED = Path(__file__).with_name("pii_tagger.npz")


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    """The fitted tagger; it is trained anew where its arrays are not there."""
    if not FITTED.exists():
        return trained()
    model = Tagger()
    with np.load(FITTED) as held:
        model.p = {k: held[k] for k in model.p}
    return model


@lru_cache(maxsize=2)
def trained(steps: int = 2500, batch: int = 64, seed: int = 7) -> Tagger:
    """A tagger trained on written samples with Adam; the same seed gives the same tagger."""
    from plansift.llm.pii_samples import sample

    model, rng = Tagger(seed), np.random.default_rng(seed + 1)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, steps + 1):
        chars, tags = zip(*(sample(rng, WINDOW) for _ in range(batch)), strict=True)
        _, g = model.gradient(np.array(chars), np.array(tags))
        norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, x in g.items():
            x = (x * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text around signs of personal data, from word end to word end, merged where they meet."""
    out: list[list[int]] = []
    for m in SIGN.finditer(text):
        if out and m.end() + MARGIN <= out[-1][1]:
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        free = out[-1][1] if out else 0
        while a > free and not text[a - 1].isspace():
            a -= 1
        end = SPACE.search(text, b)
        b = end.start() if end else len(text)
        if out and a <= free:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: The weight of each place of a window where windows overlap: greatest in the middle.
WEIGHT = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0).astype(np.float32)


def tagged_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """The model's spans of each text."""
    found: list[list[Span]] = [[] for _ in texts]
    work = [(row, a, b) for row, t in enumerate(texts) for a, b in stretches(t)]
    work.sort(key=lambda w: w[2] - w[1])
    at = 0
    while at < len(work):
        # stretches of like length together, some windows at a time
        group, windows = [], 0
        while at < len(work) and (not group or windows + 1 + (work[at][2] - work[at][1]) // STRIDE <= AT_ONCE):
            group.append(work[at])
            windows += 1 + (work[at][2] - work[at][1]) // STRIDE
            at += 1
        wide = max(b - a for _, a, b in group)
        scores = np.zeros((len(group), wide, TAGS), np.float32)
        weight = np.zeros((len(group), wide, 1), np.float32)
        chars, places = [], []
        for g, (row, a, b) in enumerate(group):
            own = codes(texts[row][a:b])
            for start in range(0, max(1, len(own) - (WINDOW - STRIDE)), STRIDE):
                part = own[start : start + WINDOW]
                chars.append(np.pad(part, (0, WINDOW - len(part))))
                places.append((g, start, len(part)))
        for k in range(0, len(chars), AT_ONCE):
            e = model.emissions(np.array(chars[k : k + AT_ONCE]))
            for (g, start, n), own in zip(places[k : k + AT_ONCE], e, strict=True):
                scores[g, start : start + n] += own[:n] * WEIGHT[:n, None]
                weight[g, start : start + n] += WEIGHT[:n, None]
        scores /= np.maximum(weight, 1e-6)
        paths = model.best_paths(scores, np.array([b - a for _, a, b in group]))
        for (row, a, _), path, own in zip(group, paths, scores, strict=True):
            k = 0
            while k < len(path):
                tag = path[k]
                end = k + 1
                if tag:
                    kind = (tag - 1) // 2
                    while end < len(path) and path[end] == 2 * kind + 2:
                        end += 1
                    # how far the tags' scores are above those of no tag
                    sure = own[np.arange(k, end), path[k:end]] - own[k:end, 0]
                    if sure.mean() >= SURE:
                        found[row].append((kind, a + k, a + end))
                k = end
    return found


def whole(text: str, span: Span) -> Span:
    """A span widened to the ends of the words it cuts, without loose ends."""
    kind, a, b = span
    inner = LOCAL if kind == 0 else DIGITS
    while a < b and not text[a].isalnum() and text[a] not in "+(":
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while a < b and a and text[a - 1] in inner:
        a -= 1
    while a < b < len(text) and text[b].isalnum():
        b += 1
    while a < b and kind == 0 and text[a] in ".%+-":
        a += 1
    return kind, a, b


def valid(text: str, span: Span) -> bool:
    """Whether the values within a span can be what its kind is; nothing is asked of the form beyond that."""
    kind, a, b = span
    own = text[a:b]
    if kind == 0:
        at = AT.search(own)
        return bool(at and own[: at.start()].strip() and STOP.search(own, at.end()) and own[b - a - 1].isalnum())
    groups = NUMBER.findall(own)
    digits = "".join(groups)
    if kind == 1:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if any(c.isalpha() for c in own):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def with_added(text: str, base: list[Span], tagged: list[Span]) -> list[Span]:
    """Base spans and the model's that overlap none of them nor each other; of the model's the earlier stays."""
    taken = sorted((a, b) for _, a, b in base)
    added: list[Span] = []
    at, free = 0, 0  # base spans before ``at`` end before whatever comes; nothing of the model's reaches beyond ``free``
    reach = list(accumulate((b for _, b in taken), max))
    for s in sorted((whole(text, s) for s in tagged), key=lambda s: s[1:]):
        while at < len(taken) and taken[at][0] < s[2]:
            at += 1
        if s[1] >= free and (at == 0 or reach[at - 1] <= s[1]) and valid(text, s):
            added.append(s)
            free = s[2]
    return sorted(base + added)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans``: all fixed-pattern spans and all spans, written as ``kind:start:end``."""
    model = tagger()

    def make():
        def work(ids: list, texts: list) -> tuple:
            base = [base_spans(t) for t in texts]
            tagged = tagged_spans(model, texts)
            both = [with_added(t, b, m) for t, b, m in zip(texts, base, tagged, strict=True)]
            counts = [[sum(s[0] == k for s in b) for b in base] for k in range(len(KINDS))]
            digests = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            return ids, *counts, digests, [written(b) for b in both], [len(s) - len(b) for s, b in zip(both, base, strict=True)]

        return work

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return map_columns(identified(docs, id_col, text_col), make, schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with each span replaced by its kind in angle brackets."""
    model = tagger()

    def make():
        def work(ids: list, texts: list) -> tuple:
            out = []
            for t, m in zip(texts, tagged_spans(model, texts), strict=True):
                parts, at = [], 0
                for k, a, b in sorted(with_added(t, base_spans(t), m), key=lambda s: s[1:]):
                    if a >= at:
                        parts += [t[at:a], f"<{KINDS[k]}>"]
                        at = b
                out.append("".join(parts) + t[at:])
            return ids, out

        return work

    return map_columns(identified(docs, id_col, text_col), make, "doc_id long, text string")


if __name__ == "__main__":
    np.savez_compressed(FITTED, **trained().p)
