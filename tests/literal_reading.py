"""Queries of text typing, tagging and page layout over small literal tables; the tables have no counterpart among the standard ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.functions.text import canonical_key, clauses, is_label, is_negated, is_noise, is_person, is_zone_marker, light_clean, of_kind, part_tokens, rejoin_continuations
from plansift.functions.vocabulary import bore_of, code_hits, fit_kind, forms, ra_of, vocabulary
from plansift.operators import layout
from plansift.operators.fields import buckets, material_class, parse_scale, parse_weight, standards, typed_record, typed_units
from plansift.operators.fingerprint import fingerprints
from plansift.operators.graph import connected_components
from plansift.operators.stats import flat_diff
from plansift.operators.tags import tag_units
from plansift.session import table


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    """A SQL table of literals."""
    def lit(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(lit(x) for x in r) + ')' for r in rows)}) AS v({names})"


UNITS = [
    (1, "Title: BEARING SUPPORT PLATE"), (2, "Weight kg 2.47"), (3, "Total weight 500 g"), (4, "Mass: 1,5 kg"), (5, "Weight 0.75 t"), (6, "Net weight 12"), (7, "Scale 1:5"), (8, "Scale: 1/10"),
    (9, "Material: S355J2 steel. See note 3"), (10, "Material changed to 60x60x8"), (11, "Coating: no coating"), (12, "Coating: RAL 7035 powder"), (13, "Gen. Tol. ISO 2768-m"), (14, "Gen Tol added"),
    (15, "Based on NRA12345"), (16, "Based on"), (17, "just some prose about plates"), (18, "Specification: EN 10025 Scale 1:2"), (19, "Finish: galvanized"), (20, "Werkstoff: 1.4301"),
]
# What the units say. A label's own full stop stays with the value (13), and a label alone is none (16).
SAID = {
    1: ("part_name", "BEARING SUPPORT PLATE"), 2: ("weight", "2.47"), 3: ("weight", "0.5"), 4: ("weight", "1.5"), 5: ("weight", "750.0"), 6: ("weight", "12.0"), 7: ("scale", "1:5"), 8: ("scale", "1:10"),
    9: ("material", "S355J2 steel"), 10: ("material", None), 11: ("coating", None), 12: ("coating", "RAL 7035 powder"), 13: ("general_tolerance", ". ISO 2768-m"), 14: ("general_tolerance", None),
    15: ("based_on", "NRA12345"), 16: (None, None), 17: (None, None), 18: ("specification", "EN 10025"), 19: ("coating", "galvanized"), 20: ("material", "1.4301"),
}


def typed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What each unit of a title block says under its label."""
    return typed_units(_rows(spark, UNITS, "unit int, text string")).select("unit", "field", "value")


_TYPED_FIELDS = "SELECT unit, field, value FROM " + _values([(u, *SAID[u]) for u, _ in UNITS], "unit, field, value")


def typed_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row of fields for a document."""
    units = _rows(spark, [(*u, "a") for u in UNITS], "position int, text string, stem string")
    r = typed_record(typed_units(units))
    return r.select("stem", F.array_join("part_name", "|").alias("part_name"), F.array_join("scale", "|").alias("scale"), F.array_join("material", "|").alias("material"), F.array_join("coating", "|").alias("coating"), "weight_kg")


_TYPED_RECORDS = "SELECT 'a' AS stem, 'BEARING SUPPORT PLATE' AS part_name, '1:5|1:10' AS scale, 'S355J2 steel|1.4301' AS material, 'RAL 7035 powder|galvanized' AS coating, 2.47::DOUBLE AS weight_kg"

VALUES_ = [(1, "2.47 kg"), (2, "kg 3"), (3, "500 g"), (4, "1,5"), (5, "2 t"), (6, "none"), (7, "1:50"), (8, "3/4")]


def weights_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Weights in kilograms and scales of short texts."""
    return _rows(spark, VALUES_, "no int, text string").select("no", parse_weight(F.col("text")).alias("kg"), parse_scale(F.col("text")).alias("scale"))


_WEIGHTS_SCALES = r"""
    SELECT no, CASE WHEN n IS NULL THEN NULL ELSE round(CASE WHEN u = 'g' THEN n / 1000 WHEN u = 't' THEN n * 1000 ELSE n END, 4) END AS kg, s AS scale FROM (
      SELECT no, replace(nullif(regexp_extract(text, '([0-9]+(?:[.,][0-9]+)?)', 1), ''), ',', '.')::DOUBLE AS n, regexp_extract(text, '[0-9] ?(kg|g|t)', 1) AS u,
             CASE WHEN regexp_matches(text, '\d[:/]\d') THEN replace(regexp_extract(text, '(\d+[:/]\d+)', 1), '/', ':') END AS s FROM """ + _values(VALUES_, "no, text") + ")"

REFS = [(1, "according to ISO 2768-mK and DIN 1026"), (2, "EN10025-2 / ISO 5817"), (3, "iso 2768-mK, ISO 2768-mK"), (4, "nothing here"), (5, "ASTM A36, BS 4360/50D")]
_FOUND = [(1, "ISO", "2768", "mK"), (1, "DIN", "1026", ""), (2, "EN", "10025", "2"), (2, "ISO", "5817", ""), (3, "ISO", "2768", "mK"), (5, "BS", "4360", "50D")]


def standards_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Standards that texts name, once each."""
    return standards(_rows(spark, REFS, "unit int, text string")).select("unit", "family", "number", "suffix")


_STANDARDS_REFS = "SELECT unit, family, number, suffix FROM " + _values(_FOUND, "unit, family, number, suffix")

CODED = [(1, "M12x1,75 grade 8.8 and S355J2+N to ISO 2768-mK"), (2, "bore H7/g6, Ra 3,2 and N8, IT7"), (3, "IP55 motor IE3, corrosivity C4, 120 um"), (4, "A4 paper, 8.8 mm, C4"), (5, "1.4301 G 1/2 weld ISO 5817-C")]
_CODES = [
    (1, 1, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1),
    (4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (5, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0),
]
_CODE_NAMES = ("metric_thread", "pipe_thread", "strength_grade", "steel_grade", "material_number", "tolerance_class", "fit_pair", "it_grade", "roughness", "roughness_number", "weld_quality", "protection", "efficiency", "corrosivity", "coating_thickness")


def structured_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Structured codes of each text; bare short codes are none."""
    return _rows(spark, CODED, "unit int, text string").select("unit", *code_hits("text", list(_CODE_NAMES)))


_STRUCTURED_CODES = "SELECT unit, " + ", ".join(f"n_{n}" for n in _CODE_NAMES) + " FROM " + _values(_CODES, "unit, " + ", ".join(f"n_{n}" for n in _CODE_NAMES))

CLAUSES = [(1, "No paint on threads See note 2"), (2, "Weld all around. Not to be ground"), (3, "plain sentence"), (4, "NOTE! surface treatment RAL 7035 no rust"), (5, ""), (6, "Without primer")]
_SPLIT = [
    (1, 0, "No paint on threads", True), (1, 1, "See note 2", False), (2, 0, "Weld all around.", False), (2, 1, "Not to be ground", True), (3, 0, "plain sentence", False),
    (4, 0, "NOTE!", False), (4, 1, "surface treatment RAL 7035", False), (4, 2, "no rust", True), (5, 0, "", False), (6, 0, "Without primer", True),
]


def clause_negation(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of run-on notes, and whether they are negated."""
    d = _rows(spark, CLAUSES, "unit int, text string").select("unit", F.posexplode(clauses(F.col("text"))).alias("no", "clause"))
    return d.select("unit", "no", "clause", is_negated(F.col("clause")).alias("negated"))


_CLAUSE_NEGATION = "SELECT unit, no, clause, negated FROM " + _values(_SPLIT, "unit, no, clause, negated")


def tag_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary and rule tags of a note about every part, by category and anchor."""
    p = table(spark, sf, "part")
    units = p.select(F.col("p_partkey").alias("unit"), F.concat(F.lit("No paint on "), "p_name", F.lit(" weld "), "p_name", F.lit(" a4 H7")).alias("text"))
    return tag_units(units, vocabulary(spark)).groupBy("category", "anchor", "negated").agg(F.countDistinct("unit").alias("n"))


_TAG_DICTIONARY = f"""
    WITH v AS (SELECT DISTINCT form, CASE WHEN library IN ('corrosion', 'surface_texture') THEN 'surface' ELSE library END AS category FROM {_values([f[:2] for f in forms()], 'form, library')}),
         t AS (SELECT p_partkey AS unit, string_split('No paint on ' || p_name || ' weld ' || p_name || ' a4 H7', ' ') AS w FROM part),
         g AS (SELECT DISTINCT unit, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS anchor FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)),
         d AS (SELECT unit, category, anchor FROM g JOIN v ON upper(anchor) = form
               UNION SELECT unit, unnest(['weld_quality', 'fits', 'process', 'process']), unnest(['a4', 'H7', 'paint', 'weld']) FROM t)
    SELECT category, anchor, true AS negated, count(DISTINCT unit) AS n FROM d GROUP BY ALL
"""

CELLS = [
    (1, "Title: FRAME", False, "block"), (2, "approved by M. Smith", False, "block"), (3, "Virta Pekka", False, "block"), (4, "welding", False, "block"), (5, "END PLATE", False, "block"), (6, "1 PLATE S355", True, "block"),
    (7, "per ISO 5817", False, "body"), (8, "free text without meaning", False, "body"), (9, "EF", False, "block"), (10, "Based on X", False, "block"),
]
_BUCKETS = {1: "classified", 2: "debug", 3: "debug", 4: "classified", 5: "unclassified", 6: "bom", 7: "classified", 8: "unclassified", 9: "debug", 10: "unclassified"}


def _bucketed(spark: SparkSession) -> DataFrame:
    units = _rows(spark, CELLS, "unit int, text string, is_bom boolean, src string")
    tagged = tag_units(units, vocabulary(spark)).select("unit").distinct().withColumn("has_tag", F.lit(True))
    return buckets(units.join(tagged, "unit", "left"), F.coalesce(F.col("has_tag"), F.lit(False)))


def bucket_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit in exactly one bucket."""
    return _bucketed(spark).select("unit", "bucket")


_BUCKET_PARTITION = "SELECT unit, bucket FROM " + _values(list(_BUCKETS.items()), "unit, bucket")


def fingerprint_text(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of a document of these units; nothing of the bill of material is in it."""
    units = _bucketed(spark).select(F.lit("a").alias("stem"), F.col("unit").alias("position"), "bucket", "src", "text", "field", "value", F.lit(False).alias("noise"))
    return fingerprints(units)


_FINGERPRINT_TEXT = "SELECT 'a' AS stem, 'welding END PLATE per ISO 5817 free text without meaning Based on X FRAME field_part_name' AS text"

CHARACTERS = [(1, "A"), (2, "F 1"), (3, "12"), (4, "123"), (5, "END PLATE"), (6, "Virta Pekka"), (7, "EF"), (8, "login7"), (9, "holes"), (10, "a-b c"), (11, "")]


def unit_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Zone markers, persons, labels and noise among short texts."""
    d = _rows(spark, CHARACTERS, "unit int, text string")
    c = F.col("text")
    return d.select("unit", is_zone_marker(c).alias("zone"), is_person(c).alias("person"), is_label(c).alias("label"), is_noise(of_kind(light_clean(c), "kept"), F.lit(0)).alias("noise"))


_UNIT_PREDICATES = "SELECT unit, zone, person, label, noise FROM " + _values(
    [(1, True, True, False, True), (2, True, False, True, True), (3, True, False, False, True), (4, False, False, False, True), (5, False, False, True, False), (6, False, True, False, False), (7, False, True, True, True),
     (8, False, True, False, False), (9, False, False, False, False), (10, False, False, False, True), (11, False, False, False, True)],
    "unit, zone, person, label, noise",
)

COMPOUNDS = [(1, "EN10029-PL10/S355J2+N"), (2, "1,5MM"), (3, "EN 10029:"), (4, "plain"), (5, "weld-\n ing")]


def token_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and keys of compound tokens, and words put together across lines."""
    d = _rows(spark, COMPOUNDS, "unit int, text string")
    return d.select("unit", F.array_join(part_tokens(F.col("text")), "|").alias("parts"), canonical_key(F.col("text")).alias("key"), rejoin_continuations(F.col("text")).alias("joined"))


_TOKEN_KEYS = "SELECT unit, parts, key, joined FROM " + _values(
    [(1, "EN10029|PL10|S355J2+N", "en10029pl10s355j2+n", "EN10029-PL10/S355J2+N"), (2, "", "1.5mm", "1,5MM"), (3, "", "en10029", "EN 10029:"), (4, "", "plain", "plain")], "unit, parts, key, joined"
) + " UNION ALL SELECT 5, 'weld|' || chr(10) || ' ing', 'welding', 'welding'"

LOOKED = [("08", "H7/g6", "N7"), ("00", "H7/p6", "N1"), ("02", "H7/k6", "n9"), ("99", "x", "N13")]


def code_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Bores, kinds of fit and roughness behind codes."""
    d = _rows(spark, LOOKED, "bore string, fit string, n string")
    return d.select("bore", bore_of(F.col("bore")).alias("mm"), fit_kind(F.col("fit")).alias("kind"), F.round(ra_of(F.col("n")), 3).alias("ra"))


_CODE_LOOKUPS = "SELECT bore, mm, kind, ra::DOUBLE AS ra FROM " + _values([("08", 40, "clearance", 1.6), ("00", 10, "interference", 0.025), ("02", 15, "transition", 6.3), ("99", None, None, None)], "bore, mm, kind, ra")


def material_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of material by the first pattern that matches."""
    d = _rows(spark, [("S355J2",), ("AISI 304",), ("EN AW aluminium",), ("POM",), ("HDG steel",), ("wood",)], "text string")
    return d.select("text", material_class(F.col("text")).alias("class"))


_MATERIAL_CLASSES = "SELECT text, class FROM " + _values([("S355J2", "steel"), ("AISI 304", "stainless"), ("EN AW aluminium", "aluminium"), ("POM", "plastic"), ("HDG steel", "galv_steel"), ("wood", None)], "text, class")

BOXES = [("d", 0, 0, 0, 0.0, 0.0, 10.0, 10.0), ("d", 0, 1, 0, 1.0, 1.0, 10.0, 10.0), ("d", 0, 2, 0, 20.0, 0.0, 30.0, 10.0), ("d", 0, 3, 0, 21.0, 1.0, 24.0, 4.0), ("d", 0, 4, 0, 26.0, 5.0, 29.0, 9.0), ("d", 1, 5, 0, 0.0, 0.0, 10.0, 10.0)]
_BOX = "doc string, page int, box int, z int, x0 double, y0 double, x1 double, y1 double"
_SQL_BOXES = _values(BOXES, "doc, page, box, z, x0, y0, x1, y1")
WORDS_ = [("d", 0, "alpha", 1.0, 1.0, 3.0, 2.0), ("d", 0, "beta", 5.0, 1.0, 7.0, 2.0), ("d", 0, "gamma", 1.0, 5.0, 3.0, 6.0), ("d", 0, "delta", 22.0, 2.0, 23.0, 3.0), ("d", 0, "out", 50.0, 50.0, 51.0, 51.0), ("d", 1, "page", 2.0, 2.0, 3.0, 3.0), ("d", 1, "edge", 19.0, 2.0, 20.0, 3.0)]
_SQL_WORDS = _values(WORDS_, "doc, page, word, x0, y0, x1, y1")


def _boxes(spark: SparkSession) -> DataFrame:
    return _rows(spark, BOXES, _BOX).drop("z")


def _words(spark: SparkSession) -> DataFrame:
    return _rows(spark, WORDS_, "doc string, page int, word string, x0 double, y0 double, x1 double, y1 double")


def boxes_iou_join(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of one page that overlap by a twentieth of their union or more."""
    return layout.overlapping_boxes(_boxes(spark), ["doc", "page"], 0.05).select("doc", "page", "a", "b", F.round("iou", 6).alias("iou"))


_BOXES_IOU_JOIN = f"""
    WITH b AS (FROM {_SQL_BOXES}), p AS (SELECT a.doc, a.page, a.box AS a, c.box AS b, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i,
      (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM b a JOIN b c ON a.doc = c.doc AND a.page = c.page AND a.box < c.box)
    SELECT doc, page, a, b, round((i / (s - i))::DOUBLE, 6) AS iou FROM p WHERE i / (s - i) >= 0.05
"""


def words_in_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The text of each cell from the words whose middle it holds."""
    inside = layout.words_in_cells(_words(spark), _boxes(spark).withColumnRenamed("box", "cell"), ["doc", "page"])
    return layout.cell_texts(inside, ["doc", "page"])


_WORDS_IN_CELLS = f"""
    SELECT w.doc, w.page, c.box AS cell, string_agg(word, ' ' ORDER BY w.y0, w.x0, word) AS text FROM (FROM {_SQL_WORDS}) w JOIN (FROM {_SQL_BOXES}) c
    ON w.doc = c.doc AND w.page = c.page AND (w.x0 + w.x1) / 2 BETWEEN c.x0 AND c.x1 AND (w.y0 + w.y1) / 2 BETWEEN c.y0 AND c.y1 GROUP BY ALL
"""


def words_outside_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Words in no cell: the body of a page."""
    return layout.words_outside(_words(spark), _boxes(spark).withColumnRenamed("box", "cell"), ["doc", "page"]).select("doc", "page", "word")


_WORDS_OUTSIDE_CELLS = f"""
    SELECT doc, page, word FROM {_SQL_WORDS.replace(' v(', ' w(')} WHERE NOT EXISTS (SELECT 1 FROM {_SQL_BOXES.replace(' v(', ' c(')}
    WHERE w.doc = c.doc AND w.page = c.page AND (w.x0 + w.x1) / 2 BETWEEN c.x0 AND c.x1 AND (w.y0 + w.y1) / 2 BETWEEN c.y0 AND c.y1)
"""


def container_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells without those that hold two smaller ones."""
    return layout.without_containers(_boxes(spark).withColumnRenamed("box", "cell"), ["doc", "page"]).select("doc", "page", "cell")


_CONTAINER_CELLS = "SELECT doc, page, box AS cell FROM " + _SQL_BOXES + " WHERE box <> 2"


def greedy_nms(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes by falling area without those that overlap a larger one by half."""
    return layout.suppress(_boxes(spark), ["doc", "page"], 0.5).select("doc", "page", "box")


_GREEDY_NMS = "SELECT doc, page, box FROM " + _SQL_BOXES + " WHERE box <> 1"

LABELLED = [("d", 0, "Material", 0.0, 0.0, 10.0, 2.0), ("d", 0, "Weight", 20.0, 0.0, 30.0, 2.0), ("d", 0, "Lonely", 80.0, 0.0, 90.0, 2.0)]
VALUED = [("d", 0, "S355", 0.0, 3.0, 9.0, 5.0), ("d", 0, "far", 0.0, 30.0, 9.0, 32.0), ("d", 0, "2 kg", 31.0, 0.0, 36.0, 2.0), ("d", 0, "side", 11.0, 0.5, 15.0, 1.5)]


def label_values(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest value below or beside each label."""
    one = _rows(spark, LABELLED, "doc string, page int, label string, x0 double, y0 double, x1 double, y1 double")
    two = _rows(spark, VALUED, "doc string, page int, value string, x0 double, y0 double, x1 double, y1 double")
    return layout.nearest_values(one, two, ["doc", "page"], 4.0, 8.0).select("doc", "page", "label", "value", "distance")


_LABEL_VALUES = "SELECT doc, page, label, value, distance::DOUBLE AS distance FROM " + _values([("d", 0, "Material", "S355", 1.0), ("d", 0, "Weight", "2 kg", 1.0)], "doc, page, label, value, distance")

LINES = [("d", 0, 1.0), ("d", 0, 1.5), ("d", 0, 2.2), ("d", 0, 5.0), ("d", 0, 5.4), ("d", 1, 9.0), ("d", 1, 20.0)]


def reading_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Lines put into bands wherever the next one is further than 1 away."""
    return layout.bands_by_gap(_rows(spark, LINES, "doc string, page int, y double"), ["doc", "page"], "y", 1.0).select("doc", "page", "y", "band")


_READING_BANDS = "SELECT doc, page, y::DOUBLE AS y, (sum(n) OVER (PARTITION BY doc, page ORDER BY y))::INT AS band FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc, page ORDER BY y) > 1 THEN 1 ELSE 0 END AS n FROM " + _values(LINES, "doc, page, y") + ")"

GRID = [
    ("d", 0, 0, "Pos", 0.0, 90.0, 10.0, 95.0), ("d", 0, 1, "Description", 12.0, 90.0, 40.0, 95.0), ("d", 0, 2, "Item No.", 42.0, 90.0, 60.0, 95.0), ("d", 0, 3, "1", 2.0, 80.0, 8.0, 85.0), ("d", 0, 4, "PLATE", 13.0, 80.0, 25.0, 85.0),
    ("d", 0, 5, "1234567", 43.0, 81.0, 58.0, 85.0), ("d", 0, 6, "2", 2.0, 70.0, 8.0, 75.0), ("d", 0, 7, "BEAM", 13.0, 70.0, 25.0, 75.0), ("d", 0, 8, "LONG", 27.0, 70.5, 38.0, 75.0), ("d", 0, 9, "away", 200.0, 70.0, 220.0, 75.0),
    ("e", 0, 0, "12 PLATE WIDE EN10029-PL10 100 200 1234567 X-DRW1 2.5", 0.0, 0.0, 50.0, 5.0), ("e", 0, 1, "no row here", 0.0, 10.0, 50.0, 15.0),
]
_CELL = "doc string, page int, cell int, text string, x0 double, y0 double, x1 double, y1 double"
_PARSED = [
    ("d", 0, 1, "2", "", "BEAM LONG", "", "", "", "", "", ""), ("d", 0, 2, "1", "", "PLATE", "", "", "", "1234567", "", ""),
    ("e", 0, 1, "12", "", "PLATE WIDE", "EN10029-PL10", "100", "200", "1234567", "X-DRW1", "2.5"),
]


def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Bills of material from a grid of cells and from whole-row cells."""
    return layout.bom_rows(_rows(spark, GRID, _CELL), ["doc", "page"])


_GRID_ROWS = "FROM " + _values(_PARSED, "doc, page, row_no, " + ", ".join(layout.SCHEMA))


def grid_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The column of each data cell, by its middle."""
    cells = _rows(spark, GRID, _CELL).withColumn("label", layout.header_label(F.col("text")))
    head = cells.filter("label is not null")
    return layout.column_of(cells.filter("label is null and doc = 'd'").drop("label"), head, ["doc", "page"]).select("doc", "page", "cell", "label")


_GRID_COLUMNS = "SELECT doc, page, cell, label FROM " + _values([("d", 0, 3, "pos"), ("d", 0, 4, "description"), ("d", 0, 5, "item_no"), ("d", 0, 6, "pos"), ("d", 0, 7, "description"), ("d", 0, 8, "description")], "doc, page, cell, label")

EDGES = [(1, 2), (2, 3), (10, 11), (12, 11), (20, 20), (13, 12), (3, 5), (30, 31)]


def components_cc(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of an edge table."""
    return connected_components(_rows(spark, EDGES, "a bigint, b bigint")).select("node", "component")


_COMPONENTS_CC = f"""
    WITH RECURSIVE e AS (SELECT a, b FROM {_values(EDGES, 'a, b')} UNION SELECT b, a FROM {_values(EDGES, 'a, b')}),
    r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
    SELECT node::BIGINT AS node, min(seen)::BIGINT AS component FROM r GROUP BY node
"""

NESTED = [("a", ["x", "y"], [("1", "PLATE")], None), ("b", [], [], 2.5)]


def content_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Fields and bill-of-material texts of nested documents."""
    d = _rows(spark, NESTED, "stem string, material array<string>, bom array<struct<pos:string,text:string>>, weight double")
    return d.select("stem", F.array_join("material", "|").alias("material"), F.array_join(F.transform("bom", lambda r: r["text"]), "|").alias("bom_texts"), F.col("weight").alias("weight_kg"))


_CONTENT_PROJECTION = "SELECT stem, material, bom_texts, weight_kg::DOUBLE AS weight_kg FROM " + _values([("a", "x|y", "PLATE", None), ("b", "", "", 2.5)], "stem, material, bom_texts, weight_kg")


def document_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Paths in which two flattened documents differ."""
    a = _rows(spark, [("x.0", "1"), ("x.1", "2"), ("y", None), ("z", "same")], "path string, value string")
    b = _rows(spark, [("x.0", "1"), ("x.1", "3"), ("w", "new"), ("z", "same")], "path string, value string")
    return flat_diff(a, b)


_DOCUMENT_DIFF = "SELECT path, first, second FROM " + _values([("x.1", "2", "3"), ("y", None, "<missing>"), ("w", "<missing>", "new")], "path, first, second")

PAIRS = [
    (typed_fields, _TYPED_FIELDS), (typed_records, _TYPED_RECORDS), (weights_scales, _WEIGHTS_SCALES), (standards_refs, _STANDARDS_REFS), (structured_codes, _STRUCTURED_CODES), (clause_negation, _CLAUSE_NEGATION),
    (tag_dictionary, _TAG_DICTIONARY), (bucket_partition, _BUCKET_PARTITION), (fingerprint_text, _FINGERPRINT_TEXT), (unit_predicates, _UNIT_PREDICATES), (token_keys, _TOKEN_KEYS), (code_lookups, _CODE_LOOKUPS),
    (material_classes, _MATERIAL_CLASSES), (boxes_iou_join, _BOXES_IOU_JOIN), (words_in_cells, _WORDS_IN_CELLS), (words_outside_cells, _WORDS_OUTSIDE_CELLS), (container_cells, _CONTAINER_CELLS), (greedy_nms, _GREEDY_NMS),
    (label_values, _LABEL_VALUES), (reading_bands, _READING_BANDS), (grid_rows, _GRID_ROWS), (grid_columns, _GRID_COLUMNS), (components_cc, _COMPONENTS_CC), (content_projection, _CONTENT_PROJECTION), (document_diff, _DOCUMENT_DIFF),
]
