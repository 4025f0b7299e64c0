"""The operators' queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm.exact_dedup import dedup_table
from plansift.llm.html_density import extract
from plansift.llm.license_scan import scan, summary
from plansift.llm.minhash import as_text, edited_likeness
from plansift.llm.mixing import mix
from plansift.llm.packing import pack
from plansift.llm.pii import find
from plansift.llm.quality import quality
from plansift.llm.simhash import hex_of, near_components
from plansift.llm.toxicity import toxicity
from plansift.session import table, texts


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document; of equal texts the row with the largest id stays."""
    return dedup_table(texts(spark, sf_dir)).drop("known")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return extract(texts(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of every document."""
    return mix(texts(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(texts(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return summary(scan(texts(spark, sf_dir)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    return edited_likeness(texts(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of every document by fingerprint."""
    return near_components(texts(spark, sf_dir)).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in as few sequences of 2048 as can be."""
    return pack(texts(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_html_extraction, op3_source_mixing, op4_toxicity, op5_quality, op6_pii, op7_license_scan, op8_fingerprints, op9_simhash,
        op10_packing, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
