from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from plansift.llm import near_copies, simhash
from tests.llm.cases import clashing, documents, empty


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def least_ids(rows):
    """The least id of each component, by all pairs."""
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(r["doc_id"], least.get(find(i), r["doc_id"]))
    return sorted((r["doc_id"], least[find(i)]) for i, r in enumerate(rows) if r["doc_id"] is not None)


def edited(n, seed=3):
    """Texts and copies with a few words changed, alike to about 0.7 to 0.95."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 300))]
        out.append(" ".join(w))
        for share in (90, 60, 40, 25):
            v = list(w)
            for _ in range(max(1, len(v) // share)):
                v[r.randrange(len(v))] = f"e{k}"
            out.append(" ".join(v))
    return out


def test_pipeline_stage_drops_pairs_alike_to_four_fifths(spark):
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(edited(60))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {c for _, c in least_ids(d.collect())}
    assert len(want) < 250
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, d, "").collect()} == want


def test_large_group_is_one(spark):
    r = random.Random(5)
    w = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(300):
        v = list(w)
        v[r.randrange(200)] = f"e{k}"
        texts.append(" ".join(v))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [x["doc_id"] for x in near_copies.keep_one(d).collect()] == [0]


def shared_passages(groups=4, each=90, seed=8):
    """Texts around a common passage, with parts of their own of many sizes: large buckets in which some pairs are alike and most are not."""
    r = random.Random(seed)
    out = []
    for g in range(groups):
        passage = [f"p{g}_{k}" for k in range(120)]
        for k in range(each):
            own = [f"o{g}_{r.randrange(6)}_{j}" for j in range(r.choice([6, 14, 25, 40, 60]))]
            out.append(" ".join(passage + own if k % 2 else own + passage))
    return out


def test_large_buckets_lose_no_link(spark):
    texts = shared_passages()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").cache()
    want = least_ids(d.collect())
    assert 20 < len({c for _, c in want}) < len(texts)
    for part in (5, 256):
        got = near_copies.near_components(d, part=part).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == want


def test_rest_pairs_are_all_that_is_left(spark):
    """Of each bucket, the pairs compared with the hub and the rest make up all pairs of different components that can be alike."""
    r = random.Random(4)
    members = {b: r.sample(range(100), r.randrange(2, 30)) for b in range(12)}
    of = {f: r.randrange(4) for f in range(100)}
    rows = [(b, f, 10, len(own), own[0], 10) for b, own in members.items() for f in own]
    met = spark.createDataFrame(rows, "bucket bigint, fp bigint, n bigint, members bigint, hub bigint, hub_n bigint")
    components = spark.createDataFrame([(f, 1000 + c) for f, c in of.items()], "node bigint, component bigint")
    hashes = {f: [f * 100 + k for k in range(10 - f % 4)] + list(range(f % 4)) for f in range(100)}
    none = [0] * (near_copies.BITS // 64)  # sets that mark nothing differ in nothing
    sets = spark.createDataFrame([(f, h, none) for f, h in hashes.items()], "fp bigint, hashes array<bigint>, bits array<bigint>")
    every = {(min(x, y), max(x, y)) for own in members.values() for x in own for y in own if of[x] != of[y]}
    for part in (3, 50):
        # buckets that are not large: nothing but components and hubs counts
        rest = {tuple(q) for q in near_copies.rest_pairs(met, components, sets, part, 1000).collect()}
        hubs = {tuple(q) for q in near_copies.hub_pairs(met).collect()}
        assert rest <= every <= rest | hubs
        # all are large: three shared shingles of ten reach nothing
        assert near_copies.rest_pairs(met, components, sets, part, 1).count() == 0


def test_bits_never_promise_too_little(spark):
    r = random.Random(9)
    rows = []
    for _ in range(300):
        x = [r.randrange(1 << 64) for _ in range(r.choice([3, 40, 400, 3000]))]
        y = r.sample(x, r.randrange(len(x) + 1)) + [r.randrange(1 << 64) for _ in range(r.choice([0, 5, 300]))]
        x, y = (np.unique(np.array(v, dtype=np.uint64)) for v in (x, y))
        rows.append((len(x), near_copies.bits_of(x).tolist(), len(y), near_copies.bits_of(y).tolist(), len(np.intersect1d(x, y))))
    d = spark.createDataFrame(rows, "n long, bits array<bigint>, n2 long, bits2 array<bigint>, common long")
    got = d.select("n", "n2", "common", near_copies.most_common(*[d[c] for c in ("n", "bits", "n2", "bits2")]).alias("most")).collect()
    assert all(q["most"] >= q["common"] for q in got) and sum(q["most"] - q["common"] for q in got if q["n"] + q["n2"] <= 90) < 200


def test_shared_shingles(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4, 5]), (3, [9]), (4, [5, 6])], "fp bigint, hashes array<bigint>")
    assert {tuple(r) for r in near_copies.shared_shingles(sets).collect()} == {(1, 2), (2, 3), (4, 1)}


def test_unrelated_texts_under_one_id_both_stay(spark):
    a, b = ("w%d " * 40) % tuple(range(40)), ("v%d " * 40) % tuple(range(40))
    d = spark.createDataFrame([(1, a), (1, b), (2, a + "x"), (3, b + "x"), (1, a), (None, a + "y"), (None, "alone and without an id")], "doc_id bigint, text string")
    for keep in (near_copies.keep_one, lambda t: simhash.keep_one(t, 6)):
        assert sorted(r["text"] for r in keep(d).collect()) == sorted([a, b, "alone and without an id"])


def test_odd_tables(spark):
    for d in (documents(spark), clashing(spark)):
        got = near_copies.near_components(d).filter("doc_id is not null").collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == least_ids(d.collect())
    assert near_copies.keep_one(empty(spark)).count() == 0

def naive_fingerprint(hashes):
    """The majority of each bit, bit by bit."""
    out = []
    for flip, times in zip(near_copies._FLIP.tolist(), near_copies._TIMES.tolist(), strict=True):
        own = []
        for h in hashes:
            x = (h ^ flip) * times % (1 << 64)
            x = (x ^ (x >> 29)) * times % (1 << 64)
            own.append(x ^ (x >> 32))
        out.append(sum((2 * sum(x >> k & 1 for x in own) + (own[0] >> k & 1) > len(own)) << k for k in range(64)))
    return out


def test_fingerprint_is_the_majority_of_bits():
    r = random.Random(2)
    for n in (1, 2, 7, 40, 5000):
        hashes = sorted(r.randrange(1 << 64) for _ in range(n))
        assert near_copies.fingerprint(np.array(hashes, dtype=np.uint64)).tolist() == naive_fingerprint(hashes)


def test_bits_differ_as_the_angle_says():
    r = np.random.default_rng(6)
    differ = []
    for _ in range(300):
        x = r.integers(0, 1 << 64, 220, dtype=np.uint64)  # 180 of 220 in common, and 20 of 200 each: alike to 0.8 and a little more
        one, two = (near_copies.fingerprint(np.unique(v)) for v in (x[:200], x[20:]))
        differ.append(int(np.bitwise_count(one ^ two).sum()))
    assert abs(np.mean(differ) / 512 - np.arccos(180 / 200) / np.pi) < 0.01


def test_candidates_are_all_within_the_limit():
    r = np.random.default_rng(7)
    n = np.sort(r.integers(5, 60, 700))
    prints = r.integers(0, 1 << 64, (700, near_copies.COMPARED), dtype=np.uint64)
    for k in range(1, 700, 3):  # many that differ in few bits, some in just too many
        prints[k] = prints[k - 1]
        for at in r.permutation(64 * near_copies.COMPARED)[: r.integers(40, 80)]:
            prints[k, at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    got = [(i, j) for a, b in near_copies.close_pairs(n, prints) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = set()
    for i in range(700):
        d = np.bitwise_count(prints[i] ^ prints).astype(int)
        for j in range(i + 1, 700):
            if d[j, :2].sum() <= near_copies.FIRST and d[j].sum() <= (near_copies.LIMIT_FEW if n[i] < near_copies.FEW else near_copies.LIMIT) and n[i] >= 0.8 * n[j]:
                want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_bands_follow_the_number_of_texts():
    assert near_copies.band_plan(0) == near_copies.band_plan(4096) == (0, 1)
    for texts in (5000, 200_000, 15_000_000):
        bits, bands = near_copies.band_plan(texts)
        assert texts / 2**bits <= 4096 and (1 - near_copies.AGREE**bits) ** bands <= 0.001


def test_links_are_found_in_bands_and_in_wide_buckets(spark):
    texts = edited(120) + shared_passages(2)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").cache()
    want = least_ids(d.collect())
    for together, most in ((40, 4096), (4096, 100)):
        got = near_copies.near_components(d, together=together, most=most).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == want
