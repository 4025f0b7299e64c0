"""Tagging of text units: dictionary terms, codes and process rules by clause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.functions.text import clauses, is_negated, light_text, tokens
from plansift.session import small

# Process hints by line: words of drawing notes, English only.
PROCESS_RULES: dict[str, str] = {
    "laser": r"(?i)\blaser\b", "plasma": r"(?i)\bplasma\b", "weld": r"(?i)\bweld(?:ing|ed|s)?\b", "bend": r"(?i)\b(?:bend(?:ing|s)?|bent)\b",
    "blast": r"(?i)\b(?:shot |sand )?blast(?:ing|ed)?\b", "paint": r"(?i)\b(?:paint(?:ing|ed)?|powder.?coat\w*)\b", "machine": r"(?i)\b(?:machin(?:ing|ed)|milling|turning|drill(?:ing|ed)?)\b",
    "deburr": r"(?i)\b(?:deburr(?:ing|ed)?|grind(?:ing)?|chamfer(?:ing|ed)?)\b", "saw": r"(?i)\b(?:saw(?:ing|n)?|cutting)\b", "thread": r"(?i)\b(?:thread(?:ing|ed)?|tapp(?:ing|ed))\b",
    "pack": r"(?i)\bpack(?:ing|aging|ed)?\b", "wash": r"(?i)\b(?:wash(?:ing|ed)?|cleaning|degreas(?:ing|ed)?)\b",
}
SURFACE_RULES = (r"(?i)\bRAL[\s-]?\d{3,4}\b", r"(?i)surface treatment|paint system|coating|primer")
WELD_SIZE = r"\b(?:[saz]\d{1,2})+\b"
HOLE_FIT = r"\bH(?:1[0-8]|[1-9])\b"


def tag_units(units: DataFrame, vocabulary: DataFrame, id_col: str = "unit", text_col: str = "text", strict_parity: bool = False) -> DataFrame:
    """``unit, clause_no, clause, negated, category, anchor``: every tag of every clause, once.

    Dictionary forms are looked up by an equi-join on runs of as many words as
    the longest form has. Runs and what rules find come out of one pass over
    the clauses. With ``strict_parity`` the text is light-cleaned first and only
    single tokens are looked up, so forms of several words cannot match.
    """
    text = light_text(F.col(text_col)) if strict_parity else F.col(text_col)
    parts = units.select(F.col(id_col).alias("unit"), F.posexplode(clauses(text)).alias("clause_no", "clause")).withColumn("negated", is_negated(F.col("clause")))
    longest = 1 if strict_parity else vocabulary.agg(F.max(F.size(F.split("form", r"\s+")))).first()[0] or 1
    hit = lambda category, anchor: F.struct(category.alias("ruled"), anchor.alias("anchor"))

    def runs(t):
        n = F.size(t)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda k: i + k - 1 <= n), lambda k: F.array_join(F.slice(t, i, k), " ")))
        return F.transform(F.array_distinct(F.flatten(each)), lambda a: hit(F.lit(None).cast("string"), a))

    clause = F.col("clause")
    words = tokens(F.replace(clause, F.lit(","), F.lit(" ")))
    found = [F.element_at(F.transform(F.array(words), runs), 1)]
    found += [F.transform(F.regexp_extract_all(clause, F.lit(WELD_SIZE), 0), lambda a: hit(F.lit("weld_quality"), a)), F.transform(F.regexp_extract_all(clause, F.lit(HOLE_FIT), 0), lambda a: hit(F.lit("fits"), a))]
    once = [hit(F.lit("surface"), F.nullif(F.regexp_extract(clause, r, 0), F.lit(""))) for r in SURFACE_RULES]
    once += [hit(F.lit("process"), F.when(clause.rlike(r), F.lit(n))) for n, r in PROCESS_RULES.items()]
    found.append(F.filter(F.array(*once), lambda h: h["anchor"].isNotNull()))
    hits = parts.select("*", F.inline(F.concat(*found)))
    known = small(vocabulary.select(F.col("form").alias("__form"), F.col("category").alias("__category")).distinct())
    looked = hits.join(known, F.col("ruled").isNull() & (F.upper(F.trim("anchor")) == F.col("__form")), "left")
    return looked.select("unit", "clause_no", "clause", "negated", F.coalesce("ruled", "__category").alias("category"), "anchor").filter("category is not null").distinct()


def tag_records(tags: DataFrame) -> DataFrame:
    """Tags by clause: ``unit, clause_no, clause, negated, tags`` with a map from category to sorted anchors."""
    by = tags.groupBy("unit", "clause_no", "clause", "negated", "category").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))
    return by.groupBy("unit", "clause_no", "clause", "negated").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "anchors")))).alias("tags"))


def tag_presence(tags: DataFrame) -> DataFrame:
    """``category, anchors, negated`` over all units, once each."""
    by = tags.groupBy("unit", "clause_no", "negated", "category").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))
    return by.select("category", "anchors", "negated").distinct()
