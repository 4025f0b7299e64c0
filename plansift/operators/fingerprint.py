"""Fingerprint texts of documents from their typed units; the target side is shut out in one place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that give a token of their own, by presence and by value.
TYPED = ("part_name", "material", "coating", "general_tolerance", "scale", "specification")


@dataclass(frozen=True)
class Parts:
    """What goes into a fingerprint."""

    blocks: bool = True
    tagged: bool = True
    body: bool = True
    tags: bool = True
    fields: bool = True
    noise: bool = False
    leak_bom: bool = False


def inputs(units: DataFrame, parts: Parts = Parts()) -> DataFrame:
    """Units that may be read: never those of the bill of material, unless a leakage probe asks for them."""
    return units if parts.leak_bom else units.filter("bucket <> 'bom'")


def fingerprints(units: DataFrame, tags: DataFrame | None = None, parts: Parts = Parts(), stem: str = "stem") -> DataFrame:
    """``stem, text`` of ``units (stem, position, bucket, src, text, field, value, noise)`` and ``tags (stem, category, anchor, negated)``.

    Texts in order of position, then tag tokens, then field tokens.
    """
    own = inputs(units, parts)
    cell, body = F.col("src") == "block", F.col("src") == "body"
    read = F.lit(False)
    if parts.blocks:
        read = read | (cell & (F.col("bucket") == "unclassified"))
    if parts.tagged:
        read = read | (F.col("bucket") == "classified") & F.col("field").isNull()
    if parts.body:
        read = read | (body & (F.col("bucket") == "unclassified"))
    if not parts.noise:
        read = read & ~F.coalesce(F.col("noise"), F.lit(False))
    if parts.leak_bom:
        read = read | (F.col("bucket") == "bom")
    rows = own.filter(read).select(stem, F.lit(0).alias("part"), F.col("position").cast("string").alias("at"), F.col("position").alias("no"), "text")
    if parts.fields:
        typed = own.filter(F.col("field").isin(*TYPED) & F.col("value").isNotNull())
        token = F.concat_ws(" ", F.col("value"), F.concat(F.lit("field_"), F.col("field")))
        rows = rows.unionByName(typed.select(stem, F.lit(2).alias("part"), F.col("field").alias("at"), F.col("position").alias("no"), token.alias("text")))
    if parts.tags and tags is not None:
        mark = F.concat(F.when(F.col("negated"), "tagneg_").otherwise("tag_"), F.col("category"), F.lit("_"), F.regexp_replace(F.lower("anchor"), r"[^\p{L}\p{N}]+", "_"))
        rows = rows.unionByName(tags.select(stem, F.lit(1).alias("part"), mark.alias("at"), F.lit(0).alias("no"), mark.alias("text")).distinct())
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "no", "at", "text"))), lambda x: x["text"])
    return units.select(stem).distinct().join(rows.groupBy(stem).agg(F.array_join(ordered, " ").alias("text")), stem, "left").select(stem, F.coalesce("text", F.lit("")).alias("text"))


def page_text(pages: DataFrame, stem: str, page: str, kind: str, text: str, modes: dict[str, int | None]) -> DataFrame:
    """Texts of pages by kind up to a page of each kind (None: all), in page order."""
    keep: Column = F.lit(False)
    for k, most in modes.items():
        keep = keep | ((F.col(kind) == k) & (F.lit(True) if most is None else F.col(page) < most))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(kind).alias("k"), F.col(text).alias("t")))), lambda x: x["t"])
    return pages.filter(keep).groupBy(stem).agg(F.array_join(ordered, " ").alias("text"))


def first_on_page(rows: DataFrame, stem: str, page: str, norm: Column) -> DataFrame:
    """Rows whose folded text is on no earlier page; repeats within one page stay."""
    from pyspark.sql import Window

    return rows.withColumn("__n", norm).withColumn("__first", F.min(page).over(Window.partitionBy(stem, "__n"))).filter(F.col(page) == F.col("__first")).drop("__n", "__first")


def first_header(pages: DataFrame, stem: str, page: str, header: str) -> DataFrame:
    """The header of the first page that has one."""
    return pages.filter(F.size(header) > 0).groupBy(stem).agg(F.min_by(header, page).alias(header))
