from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plansift.llm.packing import PIECE, PLAIN, Pieces, _Classes, best_fit_classes, cut, dominating, encoder, pack, plan, reduce_classes
from tests.llm.cases import LONG, clashing, documents, empty, random_documents


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_tokenizer_s(text):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder("byte_bpe_50k.json")(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", " ", "a<|endoftext|>b", "<|endoftext|>", LONG, "\r\n\t  x", "'s 're it's", "١٢٣ ½ ² Ⅷ", "日本語テキスト", "\u0558 \u088f", "\U00010940 x", "a" * 5000, "é" * 999):
        assert encoder("byte_bpe_50k.json")(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_pieces_are_asked_of_the_model_alone():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    class Model:
        model = slow.model

    pieces = Pieces(Model)
    for text in ["hello", " hello", "\n\t ", "\x00\x7f", " " * 40, "x" * 900, "'s", "\u3042" * 50, *(chr(c) for c in range(1, 0x528) if PLAIN.fullmatch(chr(c)))]:
        for _ in range(3):
            assert np.frombuffer(pieces[text], dtype="<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_take_texts_whole():
    slow = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("", "Hello  World's 123\n", "a\u0301 \u00c5ngstr\u00f6m", LONG):
        assert encoder("word_bpe_49k.json")(text).tolist() == slow.encode(text, add_special_tokens=False).ids


BLANKS = (" " * 1_200_000, "\n" * 1_200_000, "\t" * 1_200_000, " \t" * 600_000, "x" + " " * 1_200_000 + "y", "x" * 1_200_000)


def test_long_runs():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in BLANKS:
        assert encoder("byte_bpe_50k.json")(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_long_runs_are_packed(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(BLANKS)], "doc_id bigint, text string")
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(slow.encode(t, add_special_tokens=False).ids) + 1 for t in BLANKS)
    assert sum(r["length"] for r in pack(d).collect()) == want


def test_plain_characters_are_split_as_by_the_tokenizer():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for point in range(0x110000):
        c = chr(point)
        if not 0xD800 <= point < 0xE000 and PLAIN.fullmatch(c):
            text = f"a{c}{c} 1{c}! {c} b"
            assert PIECE.findall(text) == [text[a:b] for _, (a, b) in slow.pre_tokenizer.pre_tokenize_str(text)], hex(point)


@pytest.mark.parametrize("n", [1, 5, 8, 9, 15, 16, 17, 24])
def test_cut(n):
    parts = cut(n, 8)
    assert parts[0][0] == 0 and sum(x for _, x in parts) == n and all(x == 8 for _, x in parts[1:]) and all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:], strict=False))


def slow_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= x), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(capacity - x)
        else:
            rooms[k] -= x
    return sorted(rooms)


def exact(lengths, capacity):
    """The least number of sequences, by trying all fillings."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[k]:
                i = rooms.index(r)
                go(k + 1, rooms[:i] + [r - lengths[k]] + rooms[i + 1 :])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


def used(lengths, capacity):
    return len({s for _, _, n, each, first, _ in plan(Counter(lengths), capacity) for s in range(first, first + n // each)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_loses_no_optimum(lengths):
    classes = _Classes(Counter(lengths))
    fixed = reduce_classes(classes, 20)
    rest = [x for x, n in classes.n.items() for _ in range(n)]
    assert sum(t for _, t in fixed) + (exact(rest, 20) if rest else 0) == exact(lengths, 20)
    assert all(sum(own) <= 20 for own, _ in fixed)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_classes_are_packed_as_single_pieces_are(lengths):
    got = best_fit_classes(_Classes(Counter(lengths)), 30)
    rooms = sorted(30 - sum(x * n for x, n in content) for content, times in got for _ in range(times))
    assert rooms == slow_best_fit(lengths, 30)


def test_a_pair_that_does_not_dominate_is_not_fixed():
    # beside 10 of 20 fit 7 + 3 or 5 + 5; neither dominates the other
    assert dominating(_Classes(Counter([10, 7, 5, 5, 3, 3])), 10, 20) is None
    assert dominating(_Classes(Counter([19, 5])), 19, 20) == (19,)
    assert dominating(_Classes(Counter([12, 8, 7])), 12, 20) == (12, 8)
    assert dominating(_Classes(Counter([12, 7, 6])), 12, 20) == (12, 7)


def test_plan_covers_each_rank_once():
    r = random.Random(2)
    counts = {x: r.randint(1, 400) for x in r.sample(range(1, 2049), 300)} | {2048: 77}
    seen = defaultdict(list)
    load = Counter()
    places = set()
    for length, rank, n, each, first, at in plan(counts):
        for k in range(n):
            seen[length].append(rank + k)
            s, o = first + k // each, at + (k % each) * length
            load[s] += length
            assert (s, o) not in places
            places.add((s, o))
    assert {x: sorted(v) for x, v in seen.items()} == {x: list(range(n)) for x, n in counts.items()}
    assert max(load.values()) <= 2048
    # no more sequences than best-fit decreasing alone takes, here with fewer pieces of each length
    few = {x: 1 + n % 5 for x, n in counts.items()}
    lengths = [x for x, n in few.items() for _ in range(n)]
    assert used(lengths, 2048) <= len(slow_best_fit(lengths, 2048))


def check(d, capacity=2048):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in d.collect():
        ids = [*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or min(capacity, len(ids))
        at = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    rows = pack(d, capacity).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= capacity
    assert len(by) <= -(-sum(r["length"] for r in rows) // capacity) * 1.05 + 1


def test_pack(spark):
    for d in (documents(spark), clashing(spark), random_documents(spark, 400)):
        check(d)
    check(random_documents(spark, 200), 64)
    assert pack(empty(spark)).count() == 0


def test_ids_can_be_kept(spark):
    r = pack(spark.createDataFrame([(1, "hello world")], "doc_id bigint, text string"), with_ids=True).first()
    assert r["ids"][-1] == 0 and len(r["ids"]) == r["length"]


def test_number_of_sequences_is_near_the_least():
    r = random.Random(4)
    lengths = [min(2048, int(r.expovariate(1 / 500)) + 1) for _ in range(5000)]
    assert used(lengths, 2048) <= -(-sum(lengths) // 2048) * 1.01 + 1
    assert all(sum(c) > 20 for c in combinations([11, 12, 13], 2)) and used([11, 12, 13], 20) == 3
