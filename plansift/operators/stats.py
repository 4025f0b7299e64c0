"""Corpus statistics: classes by membership, quantiles, histograms and hit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.text import as_re2

# Classes of items by their place in a bill of material, richest first, and edges of histograms.
PRIORITY = {"top_level": 4, "subassembly": 3, "leaf": 2, "uninstantiated": 1, "external": 0}
COMPONENT_EDGES = ((1, 1, "1"), (2, 3, "2-3"), (4, 7, "4-7"), (8, 15, "8-15"), (16, None, "16+"))
COVERAGE_EDGES = ((1, 1, "1"), (2, 5, "2-5"), (6, 20, "6-20"), (21, 50, "21-50"), (51, None, "50+"))


def item_classes(edges: DataFrame, items: DataFrame, parent: str = "parent", component: str = "component", item: str = "item") -> DataFrame:
    """``item, class``: parents only, both, components only, neither; external where the item master lacks it."""
    p = edges.select(F.col(parent).alias("item")).distinct().withColumn("is_parent", F.lit(True))
    c = edges.select(F.col(component).alias("item")).distinct().withColumn("is_component", F.lit(True))
    known = items.select(F.col(item).alias("item")).distinct().withColumn("known", F.lit(True))
    both = known.join(p, "item", "full_outer").join(c, "item", "full_outer")
    up, down = F.col("is_parent").isNotNull(), F.col("is_component").isNotNull()
    return both.select(
        "item",
        F.when(F.col("known").isNull(), "external").when(up & ~down, "top_level").when(up & down, "subassembly").when(down, "leaf").otherwise("uninstantiated").alias("class"),
    )


def richest_class(linked: DataFrame, classes: DataFrame, stem: str = "stem") -> DataFrame:
    """The class of highest priority among each stem's items."""
    order = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return linked.join(classes, "item").groupBy(stem).agg(F.max_by("class", F.element_at(order, F.col("class"))).alias("class"))


def with_share(counts: DataFrame, n: str = "n", name: str = "share") -> DataFrame:
    """Counts with their share of all; for tables of a few groups."""
    return counts.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy()))


def histogram(rows: DataFrame, value: str, edges: tuple = COMPONENT_EDGES) -> DataFrame:
    """``bucket, n`` over inclusive edges; an upper edge of None is open."""
    at: Column | None = None
    for low, high, name in edges:
        test = (F.col(value) >= low) if high is None else F.col(value).between(low, high)
        at = F.when(test, name) if at is None else at.when(test, name)
    return rows.withColumn("bucket", at).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def log_bucket(value: Column) -> Column:
    """The power of two below a number, from 0."""
    return F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))).cast("int")


def quartiles_by_index(rows: DataFrame, value: str, groups: list[str] | None = None, points: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles as the value at place ``floor(p n)`` of the sorted values, from 0.

    Values are counted first and ranks summed over the counts, so a group is
    never collected: each distinct value is one row.
    """
    own = list(groups or [])
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*own, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*own).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("__upto", F.sum("__n").over(w)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*own)))
    picks = [F.min(F.when(F.col("__upto") > F.floor(F.lit(p) * F.col("__all")), F.col(value))).alias(f"p{int(100 * p)}") for p in points]
    return upto.groupBy(*own).agg(*picks, F.max("__all").alias("n"))


# Classes of symbols and notes, each with its patterns; those of colours and materials mind the case.
SYMBOL_CLASSES: dict[str, list[str]] = {
    "welding_iso2553": [r"ISO[\s\-]*2553"],
    "surface_finish": [r"ISO[\s\-]*1302", r"ISO[\s\-]*21920", r"\bR[az]\s*[<=≤]?\s*\d+(\.\d+)?\b", r"\bSa\s*2[½\.5]?\b", r"Pintakäsittely", r"Karheus", r"Roughness"],
    "iso_2768": [r"ISO[\s\-]*2768", r"\b2768-[mfvcMFVC]\b"],
    "gd_t": [r"[⌖⌭⊥∥▱◎⌒∠]", r"\bDatum\b", r"\bGD&T\b", r"\bPosition tol\b", r"\bFlatness\b", r"\bParallelism\b", r"\bPerpendicularity\b"],
    "ral_color": [r"\bRAL\s*\d{4}\b"],
    "material_grade": [
        r"\bS\s*2[35]5\b", r"\bS\s*355\b", r"\bEN\s*10025\b", r"\bAISI\s*\d{3}\b", r"\b1\.\d{4}\b", r"\bDX\d{2,3}D[+\-][A-Z0-9\-+]+", r"\bHDG\s*STEEL", r"\bGalvani[sz]ed\b", r"\bStainless\s*Steel",
        r"\bAluminium\b", r"\bAluminum\b", r"Material:", r"Materiaali:",
    ],
    "diameter_signs": [r"[⌀Øø]", r"\bDIA\b", r"\bDiameter\b", r"\bD\d{2,3}\b(?=[\s,\-\.])"],
    "finnish_present": [r"Pintakäsittely", r"Värisävy", r"Mittakaava", r"Karheus", r"Materiaali"],
}
MIND_CASE = {"ral_color", "material_grade"}


def symbol_hits(text: Column) -> list[Column]:
    """A column for each class of symbols: how often its patterns stand in a text, each counted by itself."""
    def count(name: str) -> Column:
        each = [F.regexp_count(text, F.lit(as_re2(p if name in MIND_CASE else f"(?i){p}"))) for p in SYMBOL_CLASSES[name]]
        total = each[0]
        for e in each[1:]:
            total = total + e
        return total

    return [count(n).alias(n) for n in SYMBOL_CLASSES]


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every one of the tables has."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.intersect(t.select(key))
    return out.distinct()


def pattern_hits(docs: DataFrame, text: str, patterns: dict[str, str], groups: list[str]) -> DataFrame:
    """Documents with a hit and all hits, for each pattern and group, in one pass over the texts."""
    counted = docs.select(*groups, *[F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).alias(n) for n, p in patterns.items()])
    return counted.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("docs"),
        *[x for n in patterns for x in (F.sum((F.col(n) > 0).cast("int")).alias(f"docs_{n}"), F.sum(n).alias(f"hits_{n}"))],
    )


def document_frequency(edges: DataFrame, parent: str, component: str) -> DataFrame:
    """``component, parents``: in how many different parents a component is."""
    return edges.select(parent, component).distinct().groupBy(F.col(component).alias("component")).agg(F.count(F.lit(1)).alias("parents"))


def best_per_group(rows: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """The name of the best score of each group; of equal scores the lesser name."""
    return rows.groupBy(group).agg(F.min_by(name, F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias(name), F.max(score).alias(score))


def token_capture(docs: DataFrame, id_col: str, counts: DataFrame) -> DataFrame:
    """Tokens per document: least, median, mean, most, and the documents without any; from ``id, term, tf``."""
    per = docs.select(F.col(id_col).alias("id")).join(counts.groupBy("id").agg(F.sum("tf").alias("tokens")), "id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return per.agg(F.min("tokens").alias("least"), F.avg("tokens").alias("mean"), F.median("tokens").alias("median"), F.max("tokens").alias("most"), F.sum((F.col("tokens") == 0).cast("int")).alias("empty"))


def flat_diff(a: DataFrame, b: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Paths whose values differ between two flattened documents; a missing path shows as ``<missing>``."""
    x, y = a.select(path, F.col(value).alias("first")), b.select(path, F.col(value).alias("second"))
    held = x.withColumn("__x", F.lit(1)).join(y.withColumn("__y", F.lit(1)), path, "full_outer")
    differs = F.col("__x").isNull() | F.col("__y").isNull() | ~F.col("first").eqNullSafe(F.col("second"))
    missing = F.lit("<missing>")
    return held.filter(differs).select(path, F.when(F.col("__x").isNull(), missing).otherwise(F.col("first")).alias("first"), F.when(F.col("__y").isNull(), missing).otherwise(F.col("second")).alias("second"))
