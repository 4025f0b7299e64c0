"""Edge cases of the operators, on tables written here."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plansift import registry
from plansift.functions.text import undouble
from plansift.operators import evaluate, stats
from plansift.operators.features import ALPHA_WORDS, CHARS, Config, char_ngrams, tfidf
from plansift.operators.graph import connected_components
from plansift.operators.retrieval import knn, sparse_knn
from plansift.operators.splits import by_rarest_label, by_stratum, greedy_iterative
from plansift.streaming.incremental import pending, quarantine, run_new_files


def test_undouble(spark):
    cases = {"a b a b": "a b", "a a": "a", "a b a": "a b a", "": "", "x": "x", "a b b a": "a b b a"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", undouble(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == cases


def test_char_ngrams_within_words(spark):
    def slow(text):
        out = []
        for w in text.lower().split():
            w = f" {w} "
            for n in range(3, 5):
                if n == 3 or len(w) >= n:
                    out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
        return Counter("c:" + g for g in out)

    for text in ["", "a", "ab cd", "Schweiß naht", "  x  yz "]:
        got = spark.createDataFrame([(text,)], "t string").select(char_ngrams(F.col("t"), CHARS).alias("g")).first()["g"]
        assert Counter(got) == slow(text)


def test_tfidf_formula_and_fit(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, ""), (4, None)], "id int, t string")
    config = Config(high=1, min_df=1)
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf(docs, "id", "t", config).collect()}
    idf = {"alpha": math.log(5 / 3) + 1, "beta": math.log(5 / 2) + 1}
    a, b = idf["alpha"], (1 + math.log(2)) * idf["beta"]
    assert got[(1, "w:alpha")] == pytest.approx(a / math.hypot(a, b))
    assert got[(1, "w:beta")] == pytest.approx(b / math.hypot(a, b))
    fitted = {r["term"] for r in tfidf(docs, "id", "t", config, docs.filter("id = 2")).collect()}
    assert fitted == {"w:alpha", "w:gamma"}


def test_knn_ties_pool_and_size(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 1.0])], "id bigint, v array<double>")
    got = knn(v, v, 3, "id", "v").collect()
    assert {(r["query"], r["candidate"]) for r in got if r["query"] == 0} == {(0, 1), (0, 2), (0, 3)}
    assert all(r["query"] != r["candidate"] for r in got)
    few = knn(v, v, 10, "id", "v", allowed=v.filter("id < 2").select("id")).collect()
    assert Counter(r["query"] for r in few) == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 9: 2}
    absent = knn(v.filter("id = 77"), v, 3, "id", "v")
    assert absent.count() == 0


def test_sparse_knn_against_all_pairs(spark):
    r = random.Random(5)
    docs = {i: {t: r.random() for t in r.sample(range(40), r.randint(0, 9))} for i in range(90)}
    df = spark.createDataFrame([(i, list(d), list(d.values())) for i, d in docs.items()], "id bigint, terms array<bigint>, weights array<double>")
    got = {}
    for x in sparse_knn(df, df, 4, block=16).collect():
        got.setdefault(x["query"], []).append((x["rank"], x["candidate"]))
    for q, d in docs.items():
        sims = sorted(((-round(sum(w * e.get(t, 0) for t, w in d.items()), 9), c) for c, e in docs.items() if c != q))
        want = [c for s, c in sims if s < 0][:4]
        assert [c for _, c in sorted(got.get(q, []))] == want


def test_overlap_edges(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "query string, value int")
    p = spark.createDataFrame([("a", 1), ("a", 3), ("c", 1)], "query string, value int")
    got = {r["query"]: r for r in evaluate.overlap(t, p).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["precision"] == 0.5 and got["a"]["jaccard"] == pytest.approx(1 / 3) and got["a"]["off_by"] == 2
    assert got["b"]["precision"] == 0.0 and got["b"]["hit"] == 0
    assert all(r["jaccard"] <= r["f1"] for r in got.values())


def test_min_max_without_span(spark):
    s = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "q string, c string, s double")
    assert {r["x"] for r in evaluate.min_max(s, "s", "x").collect()} == {0.0}


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_splits(spark):
    rows = spark.createDataFrame([(i, f"l{i % 3}") for i in range(300)] + [(1000 + i, None) for i in range(20)], "id int, label string")
    split = by_rarest_label(rows, "id", "label")
    assert split.count() == 320 and split.select("id").distinct().count() == 320
    shares = rows.filter("label is not null").join(split, "id").groupBy("label", "split").count().collect()
    assert all(abs(x["count"] - {"train": 70, "val": 15, "test": 15}[x["split"]]) <= 1 for x in shares)
    g = greedy_iterative(rows.filter("label is not null"), "id", "label")
    assert {x["split"]: x["count"] for x in g.groupBy("split").count().collect()} == {"train": 210, "val": 45, "test": 45}
    s = by_stratum(rows.filter("label is not null"), "id", "label")
    assert {x["count"] for x in s.filter("split = 'train'").join(rows, "id").groupBy("label").count().collect()} == {80}


def test_quartiles_by_index(spark):
    for n in (1, 2, 3, 4, 7, 10):
        v = sorted(random.Random(n).choices(range(5), k=n))
        got = stats.quartiles_by_index(spark.createDataFrame([(x,) for x in v], "v int"), "v").first()
        assert [got["p25"], got["p50"], got["p75"]] == [v[int(p * n)] for p in (0.25, 0.5, 0.75)]


def test_label_frequency_edge(spark):
    from plansift.operators.models import frequent_labels

    rows = spark.createDataFrame([(i, "a") for i in range(20)] + [(i, "b") for i in range(19)] + [(0, "b")], "id int, label string")
    assert [r["label"] for r in frequent_labels(rows, "id", "label", 20).collect()] == ["a"]


def test_pending_and_quarantine(spark):
    todo, done = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert sorted(r["k"] for r in pending(todo, done, "k").collect()) == [1, 3]
    good, bad = quarantine(spark.createDataFrame([(1,), (None,)], "k int"), F.col("k") > 0)
    assert good.count() == 1 and bad.count() == 1


def test_stream_takes_each_file_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    for batch in range(2):
        spark.range(batch * 10, batch * 10 + 10).write.mode("append").parquet(src)
        run_new_files(spark, src, "id bigint", sink, ck, lambda df: df.withColumn("twice", F.col("id") * 2))
        assert spark.read.parquet(sink).count() == 10 * (batch + 1)


def test_streaming_windows(spark, small):
    from plansift.streaming.windows import tumbling

    events = spark.read.parquet(f"{small}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(small)
    q = tumbling(stream, "1 day", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == tumbling(events, "1 day").count()


def test_registry():
    registry.register_metric("none", lambda t, p: t)
    assert "none" in registry.names("metric") and registry.named("metric", "none")(1, 2) == 1
    with pytest.raises(ValueError, match="there is"):
        registry.register_metric("none", None)
    assert ALPHA_WORDS.high == 1


def test_buckets_order(spark):
    from pyspark.sql import functions as F

    from plansift.operators.fields import buckets

    u = spark.createDataFrame([("Title: all rights reserved", False), ("approved by X", False), ("Scale 1:5", True)], "text string, is_bom boolean")
    got = lambda first: [r["bucket"] for r in buckets(u, F.lit(False), named_first=first).collect()]
    assert got(True) == ["classified", "debug", "bom"] and got(False) == ["debug", "debug", "bom"]


def test_ties_go_to_the_lesser_name(spark):
    from plansift.operators.stats import best_per_group

    d = spark.createDataFrame([("g", 2.0, "b"), ("g", 2.0, "a"), ("g", 1.0, "0"), ("h", -1.0, "z"), ("h", -1.0, "y")], "g string, s double, n string")
    for rows in (d, d.orderBy("n"), d.repartition(3)):
        assert sorted((r["g"], r["n"]) for r in best_per_group(rows, "g", "s", "n").collect()) == [("g", "a"), ("h", "y")]


def test_vectors_that_are_missing_or_of_another_length(spark):
    from plansift.operators.retrieval import knn

    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.6, 0.8]), (4, [0.0, 1.0])], "id bigint, v array<double>")
    assert {(r["query"], r["candidate"]) for r in knn(d, d, 1, "id", "v").collect()} == {(1, 3), (3, 4), (4, 3)}
    with pytest.raises(Exception, match="unlike lengths"):
        knn(d.union(spark.createDataFrame([(5, [1.0])], d.schema)), d, 1, "id", "v").collect()


def test_group_votes_are_those_of_all_pairs(spark):
    import random

    from plansift.operators.evaluate import group_vote_counts, group_votes, overlap, vote
    from pyspark.sql import functions as F

    r = random.Random(3)
    members = spark.createDataFrame([(q, q % 7 if q < 60 else 0) for q in range(80)], "query bigint, g bigint")
    own = spark.createDataFrame(sorted({(r.randrange(75), r.randrange(9)) for _ in range(160)}), "query bigint, value bigint")
    pairs = members.join(members.withColumnRenamed("query", "candidate"), "g").filter("query <> candidate")
    for least in (1, 2):
        want = vote(pairs, own, least, key="query")
        assert sorted(map(tuple, group_votes(members, own, "g", least).collect())) == sorted(map(tuple, want.collect()))
    a = overlap(own, vote(pairs, own, 1, key="query")).agg(F.sum("n_true"), F.sum("n_pred"), F.sum("n_both")).first()
    b = group_vote_counts(members, own.withColumn("scope", F.lit("all")), "g").first()
    assert tuple(a) == (b["n_true"], b["n_pred"], b["n_both"])


def test_bom_row_columns(spark):
    from plansift.operators.layout import bom_row
    from pyspark.sql import functions as F

    texts = {
        "12 PLATE WIDE EN10029-PL10 100 200 1234567 X-DRW1 2.5": ("12", "", "PLATE WIDE", "EN10029-PL10", "100", "200", "1234567", "X-DRW1", "2.5"),
        "3 BOLT 7654321": ("3", "", "BOLT", "", "", "", "7654321", "", ""), "4 S355 1 2 3": ("4", "", "", "S355", "1", "2", "", "", "3"), "5": ("5", "", "", "", "", "", "", "", ""),
        "6 A 1234567 B 7654321 HDG": ("6", "", "A 1234567 B", "HDG", "", "", "7654321", "", ""),
    }
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", bom_row(F.col("t")).alias("r")).collect():
        assert tuple(r["r"]) == texts[r["t"]], r["t"]
