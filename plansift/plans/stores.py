"""Queries that write a table in the form of one of the engine's inputs and read it back: sources and sinks by round trip.

What is written lies in the shared folder, under a name of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.operators.evaluate import ranking
from plansift.session import shared_dir, table
from plansift.sources import readers
from plansift.streaming.incremental import pending, run_new_files


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plansift/{name}-{uuid.uuid4().hex}"


def items_table(spark: SparkSession, sf: str) -> DataFrame:
    """Item master as it is exported, semicolons and Latin-1, and the weights with a decimal comma in it."""
    at, p = _at(spark, "items"), table(spark, sf, "part")
    p.select(
        F.concat(F.lit("Ä"), F.col("p_partkey").cast("string")).alias("Item"), F.concat("p_name", F.lit("--ø")).alias("Item description"), F.lit(None).cast("string").alias("Product family description"),
        F.when(F.col("p_size") % 5 > 0, F.concat(F.col("p_size").cast("string"), F.lit(",25"))).otherwise("none").alias("Net weight"),
    ).write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(at)
    return readers.net_weights(readers.business_table(spark, at, readers.ITEMS))


_ITEMS_TABLE = "SELECT 'Ä' || p_partkey AS item, p_size + 0.25::DOUBLE AS weight FROM part WHERE p_size % 5 > 0"


def nested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the nested document of each order, written as JSON and read with its schema."""
    at, l = _at(spark, "pages"), table(spark, sf, "lineitem")
    cell = F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("text"), F.array(F.col("l_linenumber").cast("double"), F.lit(0.0), F.col("l_quantity"), F.lit(1.0)).alias("bbox_pt"), F.lit(0).alias("page"), (F.col("l_returnflag") == "R").alias("is_bom"), F.lit(False).alias("is_zone"))
    d = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    pages = F.array(F.struct(F.lit(0).alias("page_idx"), F.lit("vector").alias("route"), F.size("cells").alias("wc"), "cells"))
    readers.write_documents(d.select(F.col("l_orderkey").cast("string").alias("stem"), F.lit("v").alias("vendor"), F.lit(1).alias("n_pages"), pages.alias("pages")), at)
    read = spark.read.schema(readers.RAW_PAGES).json(at)
    return readers.cells(read).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_bom").cast("int")).alias("n_bom"), F.max("x1").alias("x1"), F.min("text").alias("first"))


_NESTED_DOCUMENTS = "SELECT l_orderkey::VARCHAR AS stem, count(*) AS n, sum((l_returnflag = 'R')::INT) AS n_bom, max(l_quantity) AS x1, min('P' || l_partkey) AS first FROM lineitem GROUP BY 1"


def partitioned_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON in folders by language and read again, pruned to one folder."""
    at = _at(spark, "documents")
    readers.write_documents(table(spark, sf, "documents").select("doc_id", "text", "lang"), at, "lang")
    return spark.read.schema("doc_id long, text string, lang string").json(at).filter("lang = 'fr'").select("doc_id", F.md5("text").alias("text_md5"))


_PARTITIONED_DOCUMENTS = "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE lang = 'fr'"


def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and their manifest, written apart, read as one index of length 1; what is there is not written again."""
    at, e = _at(spark, "index"), table(spark, sf, "embeddings")
    doubled = e.select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x * 2).alias("vector"))
    readers.write_index(doubled, f"{at}/vectors")
    readers.write_index(doubled.withColumn("vector", F.array(F.lit(0.0).cast("float"))), f"{at}/vectors")
    readers.write_documents(e.select(F.col("vec_id").alias("row"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("stem"), (F.col("vec_id") % 7).cast("int").alias("view")), f"{at}/manifest")
    v = readers.vector_index(spark, at)
    return v.groupBy("stem", "view").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("vector", 0)), 5).alias("first"))


_INDEX_ROUND_TRIP = """
    WITH e AS (SELECT label, vec_id, embedding[1]::DOUBLE AS a, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
    SELECT 's' || label AS stem, (vec_id % 7)::INT AS view, count(*) AS n, round(sum(a / n), 5) AS first FROM e GROUP BY ALL
"""


def judged_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked runs, the key of a judged set and the letters marked in it, each from its own kind of file."""
    at, p = _at(spark, "judged"), table(spark, sf, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query"), "p_partkey", "p_size")
    names = F.array(*[F.concat(F.lit("s"), (F.col("p_partkey") + k).cast("string")) for k in range(3)])
    readers.write_documents(p.select("query", names.alias("candidates"), F.array(F.lit(0.9), F.lit(0.8), F.lit(0.7)).alias("scores")), f"{at}/runs")
    readers.write_documents(p.select("query", F.map_from_arrays(F.array(F.lit("A"), F.lit("B"), F.lit("C")), names).alias("letters")), f"{at}/key")
    p.select(F.col("query").alias("query_id"), F.when(F.col("p_size") % 4 == 0, "a, c").when(F.col("p_size") % 4 == 1, "b").otherwise("").alias("hit_letters")).write.option("header", True).csv(f"{at}/marks")
    marked = readers.judgments(spark, f"{at}/marks", "set").withColumn("query", F.regexp_replace("query", "^set:", ""))
    truth = marked.join(readers.judgment_key(spark, f"{at}/key"), ["query", "letter"]).select("query", F.col("stem").alias("candidate"))
    return ranking(readers.run_file(spark, f"{at}/runs"), truth, 3).select("query", "success", "p_at_1", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


_JUDGED_FILES = "SELECT 'q' || p_partkey AS query, 1 AS success, (p_size % 4 = 0)::INT AS p_at_1, CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS reciprocal_rank FROM part WHERE p_size % 4 < 2"


def split_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by the part of a split that is kept as lists in one file."""
    at = _at(spark, "split")
    parts = [("train", 0, 7), ("val", 7, 8), ("test", 8, 10)]
    stem = F.col("c_custkey").cast("string")
    lists = [F.sort_array(F.collect_list(F.when((F.col("c_custkey") % 10 >= a) & (F.col("c_custkey") % 10 < b), stem))).alias(n) for n, a, b in parts]
    readers.write_documents(table(spark, sf, "customer").agg(*lists).coalesce(1), at)
    found = readers.split_file(spark, at)
    return table(spark, sf, "orders").join(found, F.col("o_custkey").cast("string") == F.col("stem")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


_SPLIT_LISTS = "SELECT CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'val' ELSE 'test' END AS part, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"


def separated_table(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers through a file separated by tabs."""
    at = _at(spark, "tabs")
    readers.write_separated(table(spark, sf, "supplier"), at)
    return readers.separated(spark, at, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


_SEPARATED_TABLE = "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1"


def new_files_once(spark: SparkSession, sf: str) -> DataFrame:
    """Events through a stream of files in two runs: the second takes the new file alone, and what is done is not pending."""
    at, e = _at(spark, "stream"), table(spark, sf, "events").select("event_id", "event_type", "value")
    for k in (0, 1):
        e.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{at}/in")
        run_new_files(spark, f"{at}/in", e.schema, f"{at}/out", f"{at}/checkpoint", lambda d: d.filter("value > 5"))
    done = spark.read.schema(e.schema).parquet(f"{at}/out")
    left = pending(e, done, "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("pending"))
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("done"), F.count_distinct("event_id").alias("distinct_ids")).join(left, "event_type", "left")


_NEW_FILES_ONCE = "SELECT event_type, count(*) FILTER (value > 5) AS done, count(*) FILTER (value > 5) AS distinct_ids, count(*) FILTER (value <= 5) AS pending FROM events GROUP BY 1"

PAIRS = [
    (items_table, _ITEMS_TABLE), (nested_documents, _NESTED_DOCUMENTS), (partitioned_documents, _PARTITIONED_DOCUMENTS), (index_round_trip, _INDEX_ROUND_TRIP), (judged_files, _JUDGED_FILES), (split_lists, _SPLIT_LISTS),
    (separated_table, _SEPARATED_TABLE), (new_files_once, _NEW_FILES_ONCE),
]
