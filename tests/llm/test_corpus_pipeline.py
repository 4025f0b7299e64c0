from __future__ import annotations

from collections import Counter

import corpus_pipeline
from plansift.llm.mixing import mix
from plansift.llm.packing import pack
from plansift.llm.quality import quality
from plansift.session import settle
from plansift.llm.queries import QUERIES, ORACLES, pipeline
from tests.llm.test_exact_dedup import slow as slow_groups
from tests.llm.cases import clashing, documents, empty
from tests.llm.test_near_copies import least_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        a, b = before.collect(), docs.collect()
        if k == 0:
            assert {r["doc_id"] for r in b} == {r["doc_id"] for r in quality(before, labels).filter("predicted = 1").collect()}
        elif k == 1:
            assert slow_groups(b) == slow_groups(a) or len(b) < len(a)
            last = {}
            for r in a:
                last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
            assert {r["doc_id"] for r in b} == set(last.values())
        elif k == 2:
            assert {r["doc_id"] for r in b} == {c for _, c in least_ids(a)}
        elif k == 3:
            want = Counter({r["doc_id"]: r["copies"] for r in mix(before).collect()})
            assert Counter(r["doc_id"] for r in b) == +want
        else:
            assert sorted(tuple(r)[:5] for r in b) == sorted(tuple(r)[:5] for r in pack(before).collect())


def test_odd_tables_through_all_stages(spark, small):
    """Nulls, empty and long texts, repeated rows, clashing columns and no rows at all: each stage takes what the one before it keeps."""
    for d in (documents(spark), clashing(spark), empty(spark)):
        n = d.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            d = settle(stage(spark, d, small), f"odd-{k}")
            if k < 3:
                assert d.columns == COLUMNS and d.count() <= n
                n = d.count()
        assert d.count() == 0 or n


def test_long_blanks_through_dedup_mixing_and_packing(spark, small):
    d = spark.createDataFrame([(k, t + str(k), "en", "s", None) for k, t in enumerate((" " * 1_200_000, "\n" * 1_200_000, " \t" * 600_000))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[1:]:
        d = settle(stage(spark, d, small), "blanks")
    assert d.count() > 0


def test_run(spark, small):
    rows = pipeline(spark, small).collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_and_sql(spark, small):
    from compare import connect, differences

    assert [n.split("_")[0] for n in QUERIES][:10] == [f"op{k}" for k in range(1, 11)] and "pipeline" in QUERIES
    duck = connect(small)
    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, small), sql, duck) == ""
