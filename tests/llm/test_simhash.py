from __future__ import annotations

import numpy as np
import pytest
import xxhash

from plansift.llm import simhash
from plansift.llm.queries import op9_simhash
from tests.llm.cases import clashing, documents, empty, random_documents


def slow_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def slow_components(rows):
    ids = [r["doc_id"] for r in rows]
    fps = [slow_print(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(repr((ids[i], f"{fps[i]:016x}", least.get(find(i)))) for i in range(len(rows)))


def test_against_all_pairs(spark):
    for d in (documents(spark), clashing(spark), random_documents(spark, 400, words=30)):
        got = simhash.near_components(d).select("doc_id", simhash.hex_of(simhash.F.col("fp")), "component_id").collect()
        assert sorted(repr(tuple(r)) for r in got) == slow_components(d.collect())
    assert simhash.near_components(empty(spark)).count() == 0


def test_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(str(i * 7919 % 1009) for i in range(3000))
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.simhash(text) == slow_print(text)
    assert simhash.simhash("a b c") == slow_print("A  B\nC") and simhash.simhash("a b") == slow_print("a b") and simhash.simhash("") == 0


def test_code_is_perfect():
    s = simhash._syndromes()
    assert np.array_equal(s[:5000], simhash._syndrome(np.arange(5000, dtype=np.uint32)))
    ways, beyond = simhash._ways(2)
    assert ((beyond == 0).sum(axis=1) == 1).all()
    assert (beyond <= 2).sum() == sum(__import__("math").comb(23, w) for w in range(6))


def test_every_near_pair_meets_at_a_home():
    r = np.random.default_rng(6)
    a = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in r.choice(64, int(r.integers(0, 3)), replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    row, anchor, home = simhash.anchors_of(a)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    assert len(homes) == 300 and home.sum() == 300
    row, anchor, _ = simhash.anchors_of(b)
    reach = {}
    for i, x in zip(row.tolist(), anchor.tolist(), strict=True):
        reach.setdefault(i, set()).add(x)
    assert all(homes[i] in reach[i] for i in range(300))
    assert max(map(len, reach.values())) < 80


def test_links_of_a_dense_group(spark):
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base:
        for _ in range(30):
            y = int(x)
            for bit in r.choice(64, int(r.integers(1, 5)), replace=False):
                y ^= 1 << int(bit)
            fps.add(y)
    own = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    want = {tuple(sorted((int(x), int(y)))) for i, x in enumerate(own) for y in own[:i] if (int(x) ^ int(y)).bit_count() <= 2 or ((int(x) ^ int(y)) & ((1 << 64) - 1)).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(int(x),) for x in own], "fp bigint")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_one_of_each_component_stays(spark):
    for d in (documents(spark), clashing(spark), random_documents(spark, 200, words=20)):
        kept = simhash.keep_one(d)
        assert kept.columns == d.columns
        want = {r["component_id"] for r in simhash.near_components(d).collect() if r["component_id"] is not None}
        rows = kept.collect()
        named = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert len(named) == len(set(named)) and set(named) == want
        assert len(rows) - len(named) == d.filter("doc_id is null").count()
    assert simhash.keep_one(empty(spark)).count() == 0


def test_query(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(repr(tuple(r)) for r in op9_simhash(spark, small).collect()) == slow_components(d.collect())


@pytest.mark.parametrize("threshold", [0, 1, 3])
def test_other_thresholds(spark, threshold):
    r = np.random.default_rng(9)
    x = int(r.integers(0, 1 << 62))
    fps = sorted({x, x ^ 1, x ^ 3, x ^ 7, x ^ (1 << 50), x ^ (1 << 30) ^ (1 << 10) ^ (1 << 5)})
    want = {(a, b) for i, b in enumerate(fps) for a in fps[:i] if (a ^ b).bit_count() <= threshold}
    assert {(q["a"], q["b"]) for q in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), threshold).collect()} == want
