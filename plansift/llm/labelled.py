"""Labelled rows for the classifiers: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most.
SAMPLE = 12_000
#: Rows whose remainder by FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 4, 2


def held_out(id_: Column) -> Column:
    """Whether a document's labels are kept for measuring only; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, y`` of labelled documents outside the held-out part.

    Where there are more than ``sample``, a share of them is taken by a hash of
    the id, about ``sample`` rows. Several labels of one document count as
    their greatest; rows without id or label are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # at most about SAMPLE ids and labels: a few hundred kilobytes
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(known), "doc_id")
        .select("doc_id", "text", "y")
    )
