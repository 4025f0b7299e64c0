from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import pytest

from plansift.llm.exact_dedup import DigestIndex, counted_digests, dedup_table, drop_copies, exact_dedup, name_of, open_index
from tests.llm.cases import clashing, documents, empty, random_documents


def slow(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            stays = i == keep and not seen
            seen = seen or stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)[:5]) for r in df.collect())


def fresh(spark, buckets=None):
    return open_index(spark, uuid.uuid4().hex, buckets)


def test_against_dictionary(spark):
    for d in (documents(spark), clashing(spark), random_documents(spark)):
        assert got(exact_dedup(d, fresh(spark))) == slow(d.collect())
        for batches in (1, 3, 7):
            assert got(dedup_table(d, batches)) == slow(d.collect())


def test_empty(spark):
    assert exact_dedup(empty(spark), fresh(spark)).count() == 0
    assert dedup_table(empty(spark)).count() == 0
    assert drop_copies(empty(spark)).count() == 0


def test_many_rows_without_ids(spark):
    d = spark.createDataFrame([(None, f"t{k % 7}") for k in range(500)] + [(1, "t0")], "doc_id bigint, text string")
    assert got(dedup_table(d)) == slow(d.collect())
    assert sorted(r["text"] for r in drop_copies(d).collect()) == [f"t{k}" for k in range(7)]


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, text string")


def test_later_batches_meet_the_index(spark):
    one, two = pairs(spark, (1, "a"), (2, "b")), pairs(spark, (9, "a"), (8, "c"), (7, "c"))
    index = fresh(spark)
    exact_dedup(one, index).collect()
    rows = {r["doc_id"]: r for r in exact_dedup(two, index).collect()}
    assert rows[9]["known"] and rows[9]["keep_id"] == 1 and not rows[9]["kept"]
    assert rows[8]["kept"] and not rows[7]["kept"] and index.table.count() == 3
    assert exact_dedup(empty(spark), index).count() == 0 and index.table.count() == 3


def test_a_batch_that_is_run_again_is_decided_alike(spark):
    index, d = fresh(spark), random_documents(spark)
    exact_dedup(pairs(spark, (10_000, "a b")), index)
    for run in (None, "monday"):
        first = got(exact_dedup(d, index, run))
        n = index.table.count()
        exact_dedup(pairs(spark, (20_000, f"later {run}")), index)
        assert got(exact_dedup(d, index, run)) == first and index.table.count() == n + 1
        d = d.withColumn("doc_id", d["doc_id"] + 50_000)
    assert sum("True" in r for r in got(exact_dedup(d, index))) == 0


def test_rows_of_a_lost_run_do_not_count(spark, monkeypatch):
    index, d = fresh(spark), random_documents(spark)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(DigestIndex, "_commit", lost)
        with pytest.raises(RuntimeError):
            exact_dedup(d, index)
    assert index.table.count() == 0 and spark.table(index.name).count() > 0
    assert got(exact_dedup(d, index)) == slow(d.collect())


def test_a_table_that_was_done_is_not_added_again(spark):
    d = random_documents(spark, seed=4)
    assert got(dedup_table(d)) == got(dedup_table(d)) == slow(d.collect())
    index = open_index(spark, name_of(counted_digests(d)))
    assert index.table.count() == d.select("text").distinct().count() and index.commits.count() == 3


def test_index_by_path_outlives_its_table(spark):
    index = open_index(spark, "kept_index", 5)
    exact_dedup(pairs(spark, (1, "a")), index).collect()
    spark.sql(f"DROP TABLE {index.name}")
    again = open_index(spark, "kept_index")
    assert again.buckets == 5 and again.table.count() == 1
    assert exact_dedup(pairs(spark, (2, "a")), again).first()["known"]
    with pytest.raises(ValueError, match="5 buckets"):
        open_index(spark, "kept_index", 16)


def test_rows_that_stay(spark):
    for d in (documents(spark), clashing(spark), random_documents(spark)):
        kept = drop_copies(d)
        assert kept.columns == d.columns
        assert sorted(r["text"] or "" for r in kept.collect()) == sorted({r["text"] or "" for r in d.collect()})


def test_plan_is_a_sort_merge_anti_join(spark):
    index = fresh(spark)
    groups = spark.createDataFrame([(bytearray(b"x" * 32), 1)], "digest binary, keep_id bigint")
    plan = groups.join(index.table.select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
