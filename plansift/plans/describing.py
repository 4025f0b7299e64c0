"""Queries of vendors, event properties and further models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.operators import documents as docs_
from plansift.operators.evaluate import majority_baseline
from plansift.operators.models import attention_pool, by_stated, sigmoid, vector_classifier
from plansift.session import table

VENDORS = {"first": ("NRA", "NRX"), "other": ("KV", "SKV")}


def vendor_of_source(spark: SparkSession, sf: str) -> DataFrame:
    """Vendors by prefixes of made-up file names."""
    d = table(spark, sf, "part").select(F.concat(F.when(F.col("p_size") > 30, "nra").when(F.col("p_size") > 15, "SKV").otherwise("x"), F.col("p_partkey").cast("string")).alias("stem"))
    return d.select(docs_.vendor(F.col("stem"), VENDORS, "unknown").alias("vendor")).groupBy("vendor").agg(F.count(F.lit(1)).alias("n"))


_VENDOR_OF_SOURCE = "SELECT CASE WHEN p_size > 30 THEN 'first' WHEN p_size > 15 THEN 'other' ELSE 'unknown' END AS vendor, count(*) AS n FROM part GROUP BY 1"


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    """A number out of JSON strings, by type of event."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


_EVENT_PROPS = "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(props->>'$.k') AS n FROM events GROUP BY 1"


def stated_unstated(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy over parts whose type their name states, and over the others; the guess is always the ring."""
    p = table(spark, sf, "part").select("p_name", F.when(F.col("p_size") > 25, F.substring_index("p_name", " ", -1)).otherwise("ring").alias("truth")).withColumn("guess", F.lit("ring"))
    return by_stated(p, "p_name", "truth", "guess").select("stated", "n", F.round("accuracy", 6).alias("accuracy"))


_STATED_UNSTATED = """
    WITH p AS (SELECT p_name, CASE WHEN p_size > 25 THEN regexp_extract(p_name, '[^ ]+$') ELSE 'ring' END AS truth FROM part)
    SELECT contains(upper(p_name), upper(truth)) AS stated, count(*) AS n, round(avg((truth = 'ring')::INT), 6) AS accuracy FROM p GROUP BY 1
"""


def attention_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of each label weighted by the softmax of their first place."""
    v = table(spark, sf, "embeddings").withColumn("score", F.get("embedding", 0).cast("double") * 4)
    return attention_pool(v, "label", "embedding", "score").select("label", F.round(F.get("embedding", 0), 6).alias("first"), F.round(sigmoid(F.get("embedding", 1)), 6).alias("gate"))


_ATTENTION_POOLED = """
    WITH v AS (SELECT label, embedding, exp(embedding[1]::DOUBLE * 4) AS w FROM embeddings),
         e AS (SELECT label, w, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM v), m AS (SELECT label, pos, sum(w * x) / sum(w) AS m FROM e GROUP BY ALL),
         n AS (SELECT label, pos, m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-9) AS v FROM m)
    SELECT label, round(max(v) FILTER (pos = 0), 6) AS first, round(1 / (1 + exp(-(max(v) FILTER (pos = 1)))), 6) AS gate FROM n GROUP BY label
"""


def vector_head(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of a perceptron over vectors, held out by hash."""
    from plansift.operators.splits import by_hash

    v = table(spark, sf, "embeddings").withColumn("part", by_hash(F.col("vec_id"), 0, (0.7,), ("train", "test")))
    apply = vector_classifier(v.filter("part = 'train'"), "embedding", "label", (16,))
    return apply(v).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


def majority_language(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent language and how often it would be right."""
    return majority_baseline(table(spark, sf, "documents").select(F.col("lang").alias("value"))).select("value", F.round("accuracy", 6).alias("accuracy"))


_MAJORITY_LANGUAGE = "SELECT lang AS value, round(count(*) / (SELECT count(*) FROM documents), 6) AS accuracy FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1"

PAIRS = [(vendor_of_source, _VENDOR_OF_SOURCE), (event_props, _EVENT_PROPS), (stated_unstated, _STATED_UNSTATED), (attention_pooled, _ATTENTION_POOLED), (vector_head, None), (majority_language, _MAJORITY_LANGUAGE)]
