from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plansift.llm.mixing import WEIGHTS, dependent_rounding, mix, repeat_rows, source_targets
from tests.llm.cases import clashing, documents, empty, random_documents


def slow_targets(sizes: dict, share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s] + 1e-9}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30, None: 5}, {"a": 0, "b": 0}, {"a": 1, "b": 100, "c": 100, "d": 1}, {None: 7}, {"z": 5, "Z": 5, "ä": 5, "é": 500}, {"a": 3, "b": 1, "c": 2}])
def test_targets(spark, sizes):
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in rows} == slow_targets(sizes)


def check(d):
    rows = mix(d).collect()
    given = sorted(((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in d.collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == given
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
    want = slow_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert sorted(map(repr, mix(d).collect())) == sorted(map(repr, rows))


def test_mix(spark):
    for d in (documents(spark), clashing(spark), random_documents(spark, 400), random_documents(spark, 2000, longest=8)):
        check(d)
    assert mix(empty(spark)).count() == 0
    assert mix(documents(spark).filter("text is null")).first()["taken"] == 0


def test_expectation_is_the_fraction(spark):
    items = spark.createDataFrame([("s", i, 1 + i % 7, 0, 0.1 + 0.8 * (i % 10) / 10, 1) for i in range(100)], "source string, doc_id bigint, size bigint, whole bigint, p double, nth bigint")
    n, total = 60, [0] * 100
    for seed in range(n):
        rows = dependent_rounding(items, seed, group=8).collect()
        assert len(rows) == 100
        mean = sum((1 + i % 7) * (0.1 + 0.8 * (i % 10) / 10) for i in range(100))
        assert abs(sum(r["size"] * r["copies"] for r in rows) - mean) <= 7
        for r in rows:
            total[r["doc_id"]] += r["copies"]
        if seed >= 11:
            n = seed + 1
            break
    by = defaultdict(list)
    for i, t in enumerate(total):
        by[i % 10].append(t / n)
    for k, shares in by.items():
        assert abs(sum(shares) / len(shares) - (0.1 + 0.8 * k / 10)) < 0.17


def test_rows_repeat(spark):
    for d in (documents(spark), clashing(spark), random_documents(spark)):
        out = repeat_rows(d)
        assert out.columns == d.columns
        assert out.count() == mix(d).agg(F.sum("copies")).first()[0]
    assert repeat_rows(empty(spark)).count() == 0


def alike(spark, n, texts=1):
    return spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w x y z "), (F.col("id") % texts).cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang")).unionByName(
        spark.createDataFrame([(1, "a b c " * 50_000, "t", "l")], "doc_id bigint, text string, source string, lang string"))


def test_alike_rows_are_dealt_to_groups(spark):
    import plansift.llm.mixing as mixing

    most = []
    held = mixing.settle

    def watched(df, name):
        out = held(df, name)
        if name.startswith("met-"):
            most.append(out.agg(F.max(F.size("met.done"))).first()[0] or 0)
        return out

    mixing.settle = watched
    try:
        rows = mix(alike(spark, 100_000))
        assert rows.count() == 100_001
        taken = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")).collect()
    finally:
        mixing.settle = held
    assert all(abs(r["taken"] - r["target"]) <= r["size"] for r in taken)
    assert most and max(most) <= 2 * mixing.GROUP


def test_alike_rows_are_repeated(spark):
    for texts in (1, 5, 3000):
        d = alike(spark, 20_000, texts)
        out = repeat_rows(d)
        assert out.columns == d.columns and out.count() == mix(d).agg(F.sum("copies")).first()[0]
        counts = [r["count"] for r in out.filter("doc_id is null").groupBy("text").count().collect()]
        # the mix takes each row once or twice, or not at all: so also each text, as often as it stands there
        assert max(counts) <= 2 * 20_000 / texts + 2
    odd = spark.createDataFrame([(7, "a b", "s", k) for k in range(40)] + [(7, "b c", "s", 1)] * 3 + [(None, "a b", None, 2)] * 5, "doc_id bigint, text string, source string, i int")
    assert repeat_rows(odd).count() == mix(odd).agg(F.sum("copies")).first()[0]
