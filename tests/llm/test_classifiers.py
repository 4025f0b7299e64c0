from __future__ import annotations

import zlib

import numpy as np
import pytest

from plansift.llm.boosting import calibrated, fit_trees, isotonic
from plansift.llm.quality import STATISTICS, keep_good, quality, statistics
from plansift.llm.toxicity import FEATURES, features, toxicity
from tests.llm.cases import LONG, clashing, documents, empty


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))


def test_trees_learn_and_flatten():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(int)
    t = fit_trees(x[:1500], y[:1500])
    assert auc(t.margin(x[1500:]), y[1500:]) > 0.97

    def walk(row):
        m = t.start
        for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            m += leaf[node - len(f)]
        return m

    assert np.allclose(t.margin(x[:50]), [walk(v) for v in x[:50]])


@pytest.mark.parametrize("y", [[], [1], [1, 1, 1], [0, 0]])
def test_trees_without_two_classes(y):
    t = fit_trees(np.zeros((len(y), 3)), np.array(y))
    p = t.probability(np.zeros((2, 3)))
    assert p[0] == p[1] == pytest.approx((sum(y) + 0.5) / (len(y) + 1))


def test_isotonic_rises():
    r = np.random.default_rng(2)
    m = r.normal(size=500)
    y = (r.random(500) < 1 / (1 + np.exp(-3 * m))).astype(int)
    s = calibrated(np.sort(m), isotonic(m, y))
    assert (np.diff(s) >= 0).all() and 0 <= s.min() and s.max() <= 1
    assert abs(calibrated(m, isotonic(m, y)).mean() - y.mean()) < 0.05


def test_features_of_odd_texts():
    for text in ("", " ", "\n\n", LONG, "a", "!" * 5000, "A" * 100_000, "a1" * 50_000, "x " * 50_000, "\x00", "you idiot! U R an 1d10t", "s t u p i d"):
        for values, names in ((statistics(text), STATISTICS), (features(text, {"scum": (5, 0)}, -2.0), FEATURES)):
            assert len(values) == len(names) and np.isfinite(values).all()


@pytest.mark.parametrize(("operator", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_part(spark, operator, label, least):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = operator(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    score, y = np.array([r["score"] for r in held]), np.array([r[label] for r in held])
    assert auc(score, y) > least
    assert np.mean([r["predicted"] == r[label] for r in held]) > 0.95


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_tables(spark, operator):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1), (9, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for d in (documents(spark), clashing(spark)):
        rows = operator(d, labels).collect()
        assert len(rows) == d.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    assert operator(empty(spark), labels).count() == 0
    alone = operator(documents(spark), labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in alone} == {0.5}


def test_labels_of_the_held_out_part_change_nothing(spark, small):
    from pyspark.sql import functions as F

    from plansift.llm.labelled import held_out

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_filter_keeps_columns(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    want = {r["doc_id"] for r in quality(docs, labels).filter("predicted = 1").collect()}
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
