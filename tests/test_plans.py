"""Plans have the shapes that they are meant to have."""

from __future__ import annotations

import re

import pytest

from plansift.plans.catalogue import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(text: str) -> set[str]:
    return {c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)", text) for c in m.split(",") if c}


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("bom_components", {"o_orderkey", "l_orderkey", "l_partkey"}), ("log_size_buckets", {"n_chars"}), ("head_noun_type", {"p_name"}), ("singleton_share", {"l_orderkey", "l_partkey", "l_suppkey"}),
        ("family_of_order", {"o_orderkey", "o_custkey", "c_custkey", "c_mktsegment"}), ("incremental_done_antijoin", {"doc_id", "source"}), ("events_sessions", {"ts", "user_id"}),
    ],
)
def test_only_needed_columns_are_read(spark, small, name, columns):
    assert columns_read(plan(QUERIES[name](spark, small))) <= columns


def test_filters_reach_the_scan(spark, small):
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,10)" in plan(QUERIES["component_coverage"](spark, small))


def test_top_k_is_limited_before_the_shuffle(spark, small):
    assert plan(QUERIES["tfidf_newdoc"](spark, small)).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["linkage_heads", "linkage_fallback", "second_pass_linkage", "words_in_cells", "boxes_iou_join", "grid_columns", "tfidf_newdoc", "tag_dictionary"])
def test_no_pair_of_all_rows(spark, small, name):
    assert not re.search("NestedLoop|Cartesian", plan(QUERIES[name](spark, small)))


@pytest.mark.parametrize("name", ["light_clean_counts", "typed_fields", "tfidf_weights", "vote_components", "quartiles_words", "tag_dictionary", "crosspage_dedup"])
def test_no_python(spark, small, name):
    assert not re.search(r"EvalPython|MapIn(?:Arrow|Pandas)|InPandas", plan(QUERIES[name](spark, small)))
