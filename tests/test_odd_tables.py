"""Queries against their SQL twins over tables that the standard ones have nothing of."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from compare import TABLES, connect, differences

from plansift.operators import layout, retrieval
from plansift.plans.catalogue import ORACLES, QUERIES

# letters beyond ASCII beside words, letters that fold into ASCII, a vertical tab, and empty and unknown fields
ODD = """
    SELECT * FROM (VALUES (0, 'La èEN 4102209 und IſO 2768-m, DIN\x0b912 x', 'de', 'a'), (1, '', 'de', 'a'), (2, 'PINTAKÄSITTELY éRa 3,2 Roughneſs', NULL, 'b'), (3, 'Ra 5é ISO 5817é S355ä und D50\x0b', 'es', 'b'),
        (4, 'éS355J2 ISO\x0b2768', 'es', 'b'), (5, NULL, 'fr', 'c'), (6, 'x', 'fr', NULL), (8, '', 'en', 'd')) v(doc_id, text, lang, source)
"""
BIG_PARTS = "SELECT p_partkey + far AS p_partkey, * EXCLUDE (p_partkey, far) FROM part, (SELECT unnest([0, 1000000]) AS far) WHERE p_partkey BETWEEN 1 AND 40"


@pytest.fixture
def with_tables(small, tmp_path):
    """A folder of the standard tables with some of them replaced by what a SELECT gives."""

    def make(**selects: str) -> str:
        c = connect(small)
        for t in TABLES:
            if t in selects:
                c.execute(f"COPY ({selects[t]}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            else:
                os.symlink(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


@pytest.mark.parametrize("name", ["standards_context", "standards_refs", "symbol_classes", "structured_codes", "legacy_fallback"])
def test_odd_texts(spark, with_tables, name):
    at = with_tables(documents=f"SELECT doc_id::BIGINT AS doc_id, text, lang, source, length(text) AS n_chars FROM ({ODD})")
    assert differences(QUERIES[name](spark, at), ORACLES[name], connect(at)) == ""


@pytest.mark.parametrize("name", ["second_pass_linkage"])
def test_parts_beyond_a_million(spark, with_tables, name):
    at = with_tables(part=BIG_PARTS)
    assert differences(QUERIES[name](spark, at), ORACLES[name], connect(at)) == ""


@pytest.mark.parametrize("name", ["grid_rows", "grid_columns", "cells_of_strokes", "grouped_lines"])
def test_pages_are_brought_together_once(spark, small, name):
    """The rows of a page travel in one exchange, and pages go to Python many at a time."""
    text = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len({re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange (hashpartitioning\([^)]*\))", text)}) == 1
    assert "FlatMapGroupsInPandas" not in text


def test_meeting_boxes_give_the_groups_of_all_pairs():
    import random

    deal = random.Random(7)
    for n in (1, 2, 9, 40, 90):
        boxes = [(x := deal.randrange(60), x + deal.randrange(12), y := deal.randrange(60), y + deal.randrange(12)) for _ in range(n)]
        x0, x1, y0, y1 = (list(v) for v in zip(*boxes, strict=True))
        every = [(i, j) for i in range(n) for j in range(i) if not (x1[i] < x0[j] or x1[j] < x0[i] or y1[i] < y0[j] or y1[j] < y0[i])]
        assert layout._groups(n, layout._meeting(range(n), x0, x1, y0, y1)) == layout._groups(n, every)


@pytest.mark.parametrize("name", ["linkage_heads", "linkage_fallback", "second_pass_linkage"])
def test_exploded_keys_are_not_broadcast(spark, small, name):
    assert "Broadcast" not in QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_best_over_blocks_is_the_best_of_all():
    """With ties, own rows, scores that singles can't tell apart, and blocks in any order."""
    r = np.random.default_rng(3)
    for scale in (1.0, 1e-3, 1e20):
        v = np.round(r.normal(size=(300, 8)), 1) * scale
        v[20:60] = v[20]
        v[60:90] = v[60] + r.normal(size=(30, 8)) * 1e-8 * scale
        best = retrieval._Best(np.arange(300), 5, True, None)
        for at in (np.arange(200, 300), np.arange(0, 200)):
            best.meet(at, *retrieval._products(v, v[at]))
        sim = v @ v.T
        for q in range(300):
            want = sorted((j for j in range(300) if j != q), key=lambda j: (-np.round(sim[q, j], retrieval.PLACES), j))[:5]
            got = best.keys[best.rows == q]
            if scale < 1e10:
                assert got.tolist() == want
            else:
                assert np.allclose(sim[q, got], sim[q, want])


def test_relevant_rows_are_not_paired(spark, small):
    """Vectors of one label are counted, not joined with each other."""
    text = QUERIES["ap_mrr_success"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (query" not in text and "NOT (vec_id" not in text


def test_runs_of_characters_are_told_apart_in_their_row(spark, small):
    text = QUERIES["charwb_df"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((\w+)#", text)) == {"term"}
