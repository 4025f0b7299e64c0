from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plansift.llm.minhash import as_text, edited_likeness, fingerprint, likeness
from plansift.llm.queries import op8_fingerprints
from tests.llm.cases import clashing, documents, empty, random_documents


def check(d):
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in d.collect()), key=lambda r: r[0], reverse=True)
    got = {}
    for r in edited_likeness(d).withColumn("sha", F.sha2("edited", 256)).collect():
        got.setdefault(r["doc_id"] if r["doc_id"] is not None else -(1 << 63), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert hashlib.sha256(edited.encode()).hexdigest() in [r["sha"] for r in got[i]]
        assert all(r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got[i])
    prints = {}
    for r in d.select(F.coalesce("text", F.lit("")).alias("t"), as_text(fingerprint(F.col("text"))).alias("f")).collect():
        assert prints.setdefault(r["t"], r["f"]) == r["f"] and len(r["f"]) == 256


def test_edited_texts(spark):
    for d in (documents(spark), clashing(spark), random_documents(spark, 500)):
        check(d)
    check(documents(spark).filter("doc_id = 6"))
    assert edited_likeness(empty(spark)).count() == 0


def test_many_ranges(spark):
    from plansift.llm.minhash import with_next

    for n in (1, 2, 7, 100):
        d = spark.range(n).select((F.col("id") * 3).alias("doc_id"), F.col("id").cast("string").alias("text"))
        for ranges in (1, 2, 13, 200):
            rows = with_next(d, "doc_id", "text", ranges).collect()
            assert len(rows) == n and all(r["next"]["doc_id"] == (r["doc_id"] - 3 if r["doc_id"] else 3 * (n - 1)) for r in rows)


def test_hot_ids_are_split(spark):
    """Many rows of one id, or of none: rows alike in it and its text are one, and the others fill several ranges."""
    import plansift.llm.minhash as minhash

    rows = [(i, f"t{i}") for i in range(40)] + [(None, f"n{k % 150}") for k in range(400)] + [(17, f"h{k}") for k in range(300)] + [(17, "same")] * 300
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for ranges in (3, 8, 40):
        got = minhash.with_next(d, "doc_id", "text", ranges, 50).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in got) == sorted((i if i is not None else -1, t) for i, t in rows)
        # every row is the next of as many rows as there are of it, and following it leads through all of them
        name = lambda r: (r["doc_id"], r["text"])
        assert Counter(name(r["next"]) for r in got) == Counter(rows)
        order = [(r["doc_id"] if r["doc_id"] is not None else minhash.LEAST, r["next"]["doc_id"] if r["next"]["doc_id"] is not None else minhash.LEAST) for r in got]
        assert sum(a < b for a, b in order) == 1 and all(b in (a, a - 1) or (a, b) in ((0, minhash.LEAST), (minhash.LEAST, 39)) for a, b in order)


def test_a_table_without_ids(spark):
    from plansift.llm.minhash import with_next

    d = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 50_000).cast("string")).alias("text"))
    out = with_next(d, "doc_id", "text", 16, 1000)
    assert out.count() == 100_000


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_likeness_is_near_jaccard(spark):
    r = random.Random(8)
    pairs = []
    for _ in range(150):
        a = [str(r.randrange(10**6)) for _ in range(r.randint(30, 400))]
        b = list(a)
        cut = r.randrange(len(a))
        b[cut:] = [str(r.randrange(10**6)) for _ in range(len(a) - cut)]
        pairs.append((" ".join(a), " ".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("s")).collect()
    errors = []
    for x in got:
        s, t = shingles(x["a"]), shingles(x["b"])
        errors.append(x["s"] - len(s & t) / len(s | t))
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.03
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05


def test_short_texts(spark):
    rows = spark.createDataFrame([("", " \t"), ("a b", "a  b"), ("a b", "b a"), ("a", ""), ("a b c d e f", "a b c d e f")], "a string, b string")
    s = [r["s"] for r in rows.select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("s")).collect()]
    assert s[0] == s[1] == s[4] == 1.0 and s[2] < 0.3 and s[3] < 0.3


def test_query_is_native(spark, small):
    df = op8_fingerprints(spark, small)
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [4, 6, 8])
def test_number_of_bins(spark, bits):
    f = spark.createDataFrame([("a b c d e f g",)], "t string").select(fingerprint(F.col("t"), 5, bits).alias("f")).first()["f"]
    assert len(f) == (1 << bits) * 4 // 64


def slow_fingerprint(text):
    """The fingerprint as digits, step by step: bins of the shingles' hashes, probes for empty ones, low digits."""
    import re

    import xxhash

    def mixed(*parts):
        h = 42
        for p in parts:
            raw = p if isinstance(p, bytes) else p.to_bytes(8, "little") if p >= 1 << 31 else p.to_bytes(4, "little")
            h = xxhash.xxh64_intdigest(raw, h)
        return h

    w = [x.encode() for x in re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\f\r"))]
    hashes = [mixed(*w[i : i + 5]) for i in range(len(w) - 4)] or [mixed(b" ".join(w))]
    bins = [None] * 256
    for h in hashes:
        at = ((h >> 56) + 128) % 256  # signed numbers: the upper half of the bins comes first
        if bins[at] is None or h < bins[at]:
            bins[at] = h
    digits = ""
    for b, own in enumerate(bins):
        if own is None:
            probe = mixed(b"probe", b)
            start, step = probe & 255, (probe >> 32) & 255 | 1
            found = next(bins[(start + step * t) % 256] for t in range(256) if bins[(start + step * t) % 256] is not None)
            own = xxhash.xxh64_intdigest(b.to_bytes(4, "little"), xxhash.xxh64_intdigest(found.to_bytes(8, "little"), 42))
        digits += f"{own & 15:x}"
    return digits


def test_fingerprints_step_by_step(spark):
    r = random.Random(12)
    texts = ["", " \t", "one", "a b c d", "a b c d e", "ünï çödé 😀 x y z " * 3, "w " * 700] + [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(1, 900))) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in d.select("i", as_text(fingerprint(F.col("t"))).alias("f")).collect():
        assert x["f"] == slow_fingerprint(texts[x["i"]]), texts[x["i"]][:60]
