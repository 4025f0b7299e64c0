from __future__ import annotations

import json

from pyspark.sql import functions as F

from plansift.sources import readers


def test_business_table(spark, tmp_path):
    p = tmp_path / "items.csv"
    p.write_bytes("Item;Item description ;Net weight\n A1 ;Tür--x;1,50\nA2;;abc\nA3;y;-1\n".encode("latin-1"))
    t = readers.business_table(spark, str(p), readers.ITEMS)
    assert t.columns == list(readers.ITEMS)
    assert t.orderBy("Item").first()["Item description"] == "Tür--x"
    assert [tuple(r) for r in readers.net_weights(t).collect()] == [("A1", 1.5)]


def test_nested_pages(spark, tmp_path):
    page = {"page_idx": 0, "route": "vector", "wc": 3, "cells": [{"text": "A", "bbox_pt": [0, 0, 1, 1], "page": 0, "is_bom": False, "is_zone": True}], "bom_rows": [], "bom_head": [], "body_blocks": [{"text": "b c", "bbox": [0, 0, 1, 1], "words": ["b", "c"], "page": 0}]}
    for name, content in (("one; two", json.dumps({"stem": "one; two", "vendor": "x", "n_pages": 1, "pages": [page]})), ("bad", "{not json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "raw_pages.json").write_text(content)
    d = readers.nested_pages(spark, str(tmp_path))
    assert [r["stem"] for r in d.collect()] == ["one; two"]
    assert readers.cells(d).select("stem", "text", "x1").first() == ("one; two", "A", 1.0)
    assert readers.blocks(d).first()["text"] == "b c"
    assert readers.broken_pages(spark, str(tmp_path)).count() == 1
    counts = spark.createDataFrame([("one; two", "bad int")], "stem string, words string")
    assert readers.route(d, counts).first()["route"] == "ocr"


def test_row_numbers(spark):
    d = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k int")
    got = readers.with_row_numbers(d, ["k"]).collect()
    assert all(r["row_no"] == r["k"] + 1 for r in got)


def test_judgments_and_tables(spark, tmp_path):
    (tmp_path / "j.csv").write_text("query_id,hit_letters\nq1,\"a, c\"\nq2,\n")
    assert sorted(tuple(r) for r in readers.judgments(spark, str(tmp_path / "j.csv"), "set").collect()) == [("set:q1", "A"), ("set:q1", "C")]
    d = spark.createDataFrame([(1, "x")], "a int, b string")
    readers.write_separated(d, str(tmp_path / "t"))
    assert readers.separated(spark, str(tmp_path / "t"), "a int, b string").collect() == d.collect()
    one = readers.write_index(d, str(tmp_path / "i"))
    again = readers.write_index(d.withColumn("a", F.lit(2)), str(tmp_path / "i"))
    assert one.collect() == again.collect()
    assert readers.write_index(d.withColumn("a", F.lit(2)), str(tmp_path / "i"), rebuild=True).first()["a"] == 2


def test_preprocessed_folders(spark, tmp_path):
    for name, meta in (("a", '{"stem": "A 1", "page_sizes": [[1, 2]]}'), ("b", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "text.txt").write_text("two\nlines")
        if meta:
            (tmp_path / name / "meta.json").write_text(meta)
    assert [tuple(r) for r in readers.preprocessed(spark, str(tmp_path)).collect()] == [("A 1", "two\nlines", [[1.0, 2.0]])]
    assert spark.range(1).select(readers.cache_key(F.lit("x.pdf")).alias("k")).first()["k"] == __import__("hashlib").sha1(b"x.pdf").hexdigest()[:16]
