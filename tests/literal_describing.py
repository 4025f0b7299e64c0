"""Queries of document views, second-pass linkage and further models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.functions.vocabulary import vocabulary
from plansift.operators import documents as docs_
from plansift.operators import layout
from plansift.operators.evaluate import majority_baseline, ranking
from plansift.operators.fields import typed_record, typed_units
from plansift.operators.linkage import second_pass, stands_free
from plansift.operators.models import attention_pool, by_stated, sigmoid, vector_classifier
from plansift.operators.tags import tag_units
from literal_reading import UNITS, _bucketed, _rows, _values
from plansift.session import table

FORMS = [(1, "Order No: 123    see back\nScale:  1:5\nOrder No: 999\nno colon here\n  RAL: RAL 7035, ral-9005 and RAL 7035"), (2, "hot dip galvanized, painted; shot blasted"), (3, ""), (4, "see ISO 2768-mK for\ntolerances, ISO 2768-mK again; DIN 912")]


def _forms(spark: SparkSession) -> DataFrame:
    return _rows(spark, FORMS, "doc int, text string")


def key_value_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of label and value; the first of a label counts."""
    return docs_.key_values(_forms(spark), "doc", "text")


_KEY_VALUE_LINES = "SELECT id, field, value FROM " + _values([(1, "ORDER NO", "123"), (1, "SCALE", "1:5"), (1, "RAL", "RAL 7035, ral-9005 and RAL 7035")], "id, field, value")


def colours_treatments(spark: SparkSession, sf: str) -> DataFrame:
    """Colour codes and treatment words of each text."""
    return _forms(spark).select("doc", F.array_join(docs_.ral_codes(F.col("text")), ",").alias("ral"), F.array_join(docs_.treatments(F.col("text")), ",").alias("treatments"))


_COLOURS_TREATMENTS = "SELECT doc, ral, treatments FROM " + _values([(1, "7035,9005", ""), (2, "", "GALVANIZ,PAINTED,SHOT BLAST"), (3, "", ""), (4, "", "")], "doc, ral, treatments")


def standards_context(spark: SparkSession, sf: str) -> DataFrame:
    """Standards with what stands around them."""
    return docs_.standards_in_context(_forms(spark), "doc", "text")


_STANDARDS_CONTEXT = "SELECT id, family, number, suffix, context FROM " + _values([(4, "ISO", "2768", "mK", "see ISO 2768-mK for tolerances, ISO 2768-mK a"), (4, "DIN", "912", "", "ain; DIN 912")], "id, family, number, suffix, context")




def _typed(spark: SparkSession) -> DataFrame:
    return typed_units(_rows(spark, [("a", *u) for u in [*UNITS, (21, "weld all edges per ISO 5817")]], "stem string, position int, text string"))


def unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that was understood of a document, counted by reason and name."""
    t = _typed(spark)
    tags = tag_units(t, vocabulary(spark), "position").withColumnRenamed("unit", "position").withColumn("stem", F.lit("a"))
    return docs_.unit_table(t, tags).groupBy("reason", "name").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first"))


_UNIT_ROWS = "SELECT reason, name, n, first FROM " + _values(
    [("named", "part_name", 1, "BEARING SUPPORT PLATE"), ("named", "weight_kg", 5, "0.5"), ("named", "scale", 2, "1:10"), ("named", "material", 2, "1.4301"), ("named", "coating", 2, "RAL 7035 powder"),
     ("named", "general_tolerance", 1, ". ISO 2768-m"), ("named", "specification", 1, "EN 10025"), ("derived", "part_type", 1, "support"), ("derived", "material_class", 2, "stainless"),
     ("standard", "ISO", 2, "ISO 2768-m"), ("standard", "EN", 1, "EN 10025"), ("tag", "din8580+process", 1, "weld all edges per ISO 5817")], "reason, name, n, first",
)


def prose_text(spark: SparkSession, sf: str) -> DataFrame:
    """A document's fields in sentences."""
    rows = [("a", 1, "Title: END PLATE"), ("a", 2, "Material: HR"), ("a", 3, "Coating: HDG"), ("a", 4, "Scale 1:5"), ("b", 1, "nothing")]
    return docs_.prose(typed_record(typed_units(_rows(spark, rows, "stem string, position int, text string"))))


_PROSE_TEXT = "SELECT stem, text FROM " + _values([("a", "End plate. Material: hot-rolled. Surface treatment: hot-dip galvanized. Scale 1:5."), ("b", "")], "stem, text")


def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many units are in each bucket."""
    return docs_.unit_counts(_bucketed(spark).withColumn("stem", F.lit("a")))


_BUCKET_COUNTS = "SELECT 'a' AS stem, 3 AS n_classified, 3 AS n_unclassified, 3 AS n_debug, 1 AS n_bom, 10 AS n_units"

JSONS = [(1, '{"a": {"b": [1, {"c": "x"}]}, "d": null}'), (2, '[true, 2.5]')]


def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of nested documents by path."""
    return docs_.flat_paths(_rows(spark, JSONS, "id int, t string"), "id", "t")


_JSON_PATHS = "SELECT id, path, value FROM " + _values([(1, "a.b[0]", "1"), (1, "a.b[1].c", "x"), (1, "d", None), (2, "[0]", "true"), (2, "[1]", "2.5")], "id, path, value")



def legacy_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of documents in the new and the two old forms."""
    d = _rows(spark, [(1, ["x", "y"], "old", ["c"]), (2, [], "old", ["c"]), (3, None, "", ["c", "d"]), (4, None, None, None)], "id int, blocks array<string>, body string, cells array<string>")
    return d.select("id", docs_.legacy_body(d).alias("text"))


_LEGACY_FALLBACK = "SELECT id, text FROM " + _values([(1, "x y"), (2, "old"), (3, "c d"), (4, None)], "id, text")


def second_pass_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """Files linked to rows by their longest key that a description holds."""
    files = _rows(spark, [("NRA0001234-BD1 (part-77x).pdf",), ("ABCDE_9999.pdf",), ("none.pdf",)], "stem string")
    edges = _rows(spark, [(1, "see NRA0001234", "x"), (2, "y", "old NRA0001234-BD1, new"), (3, "PART-77X part-77x", None), (4, "xABCDE", "ABCDE"), (5, "NRA0001234-BD12", "")], "row_no int, parent_desc string, component_desc string")
    return second_pass(files, edges)


_SECOND_PASS_LINKAGE = "SELECT stem, key, row_no FROM " + _values([("NRA0001234-BD1 (part-77x).pdf", "NRA0001234-BD1", 2), ("ABCDE_9999.pdf", "ABCDE", 4)], "stem, key, row_no")


def boundary_search(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a needle stands free in a text."""
    d = _rows(spark, [(1, "a b1.c d", "b1.c"), (2, "ab1.c", "b1.c"), (3, "(b1.c)", "b1.c"), (4, "b1xc", "b1.c"), (5, "", "x")], "no int, text string, needle string")
    return d.select("no", stands_free(F.col("text"), F.col("needle")).alias("found"))


_BOUNDARY_SEARCH = "SELECT no, found FROM " + _values([(1, True), (2, False), (3, True), (4, False), (5, False)], "no, found")

HITS, LETTERS = [("q1", "A"), ("q1", "C"), ("q2", "B")], [("q1", "A", "s1"), ("q1", "B", "s2"), ("q1", "C", "s3"), ("q2", "B", "s1")]


def human_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How often marked hits are of the query's part type."""
    types = _rows(spark, [("q1", "plate"), ("q2", "beam"), ("s1", "plate"), ("s2", "beam"), ("s3", None)], "stem string, part_type string")
    return docs_.hit_agreement(_rows(spark, HITS, "query string, letter string"), _rows(spark, LETTERS, "query string, letter string, stem string"), types).select("hits", "same", F.round("share", 6).alias("share"))


_HUMAN_AGREEMENT = "SELECT 3 AS hits, 1 AS same, 0.333333::DOUBLE AS share"


def judged_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking measures of judged candidates."""
    runs = _rows(spark, [("q1", "B", 1), ("q1", "A", 2), ("q1", "C", 3), ("q2", "A", 1)], "query string, candidate string, rank int")
    m = ranking(runs, _rows(spark, HITS, "query string, candidate string"), 5)
    return m.select("query", "success", "p_at_1", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall", "average_precision")])


_JUDGED_RANKING = "SELECT query, success, p_at_1, reciprocal_rank::DOUBLE AS reciprocal_rank, recall::DOUBLE AS recall, average_precision::DOUBLE AS average_precision FROM " + _values([("q1", 1, 0, 0.5, 1.0, 0.583333), ("q2", 0, 0, 0.0, 0.0, 0.0)], "query, success, p_at_1, reciprocal_rank, recall, average_precision")


def neighbour_hits(spark: SparkSession, sf: str) -> DataFrame:
    """What neighbours share with their queries, by channel."""
    n = _rows(spark, [("text", "a", "b"), ("text", "a", "c"), ("visual", "a", "c")], "channel string, query string, candidate string")
    c = _rows(spark, [("a", 1), ("a", 2), ("b", 2), ("c", 3)], "stem string, value int")
    p = _rows(spark, [("a", 7), ("c", 7)], "stem string, value int")
    return docs_.neighbour_hits(n, c, p)


_NEIGHBOUR_HITS = "SELECT channel, query, candidate, shared_c, shared_p, hits FROM " + _values([("text", "a", "b", 1, 0, 1), ("text", "a", "c", 0, 1, 1), ("visual", "a", "c", 0, 1, 0)], "channel, query, candidate, shared_c, shared_p, hits")




# two cells side by side at the page's edge, one away from it, a short stroke and a slanted line
STROKES = [
    (10.0, 10.0, 90.0, 10.0), (10.0, 40.0, 90.0, 40.0), (10.0, 10.0, 10.0, 40.0), (50.0, 10.0, 50.0, 40.0), (90.0, 10.0, 90.0, 40.0), (200.0, 200.0, 260.0, 200.0), (200.0, 230.0, 260.0, 230.0),
    (200.0, 200.0, 200.0, 230.0), (260.0, 200.0, 260.0, 230.0), (60.0, 10.0, 60.0, 15.0), (20.0, 10.0, 40.0, 40.0), (300.0, 300.0, 340.0, 300.0),
]
_STROKE = "doc string, page int, x1 double, y1 double, x2 double, y2 double, width double, height double"


def cells_of_strokes(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that a page's strokes enclose and that hang together with its edge."""
    rows = [("d", 0, *s, 600.0, 800.0) for s in STROKES]
    return layout.cells_of_segments(_rows(spark, rows, _STROKE), ["doc", "page"]).select("doc", "page", "x0", "y0", "x1", "y1")


_CELLS_OF_STROKES = "SELECT doc, page, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM " + _values([("d", 0, 10, 10, 50, 40), ("d", 0, 50, 10, 90, 40)], "doc, page, x0, y0, x1, y1")

TEXT_LINES = [("d", 0, 1, 0.0, 0.0, 50.0, 10.0), ("d", 0, 2, 0.0, 15.0, 50.0, 25.0), ("d", 0, 3, 70.0, 0.0, 90.0, 10.0), ("d", 0, 4, 200.0, 0.0, 220.0, 10.0), ("d", 0, 5, 0.0, 60.0, 40.0, 70.0), ("e", 0, 6, 0.0, 0.0, 5.0, 0.2)]


def grouped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of text that belong together by their distance."""
    return layout.line_groups(_rows(spark, TEXT_LINES, "doc string, page int, line int, x0 double, y0 double, x1 double, y1 double"), ["doc", "page"]).select("line", "group")


_GROUPED_LINES = "SELECT line, grp AS \"group\" FROM " + _values([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)], "line, grp")


def degenerate_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells without those that span most of a page."""
    d = _rows(spark, [(1, 0.0, 0.0, 69.0, 10.0), (2, 0.0, 0.0, 70.0, 10.0), (3, 0.0, 0.0, 10.0, 99.0)], "cell int, x0 double, y0 double, x1 double, y1 double").withColumns({"w": F.lit(100.0), "h": F.lit(100.0)})
    return layout.without_degenerate(d, "w", "h").select("cell")


_DEGENERATE_CELLS = "SELECT 1 AS cell"


PAIRS = [
    (key_value_lines, _KEY_VALUE_LINES), (colours_treatments, _COLOURS_TREATMENTS), (standards_context, _STANDARDS_CONTEXT), (unit_rows, _UNIT_ROWS), (prose_text, _PROSE_TEXT), (bucket_counts, _BUCKET_COUNTS), (json_paths, _JSON_PATHS),
    (legacy_fallback, _LEGACY_FALLBACK), (second_pass_linkage, _SECOND_PASS_LINKAGE), (boundary_search, _BOUNDARY_SEARCH), (human_agreement, _HUMAN_AGREEMENT), (judged_ranking, _JUDGED_RANKING), (neighbour_hits, _NEIGHBOUR_HITS),
    (cells_of_strokes, _CELLS_OF_STROKES), (grouped_lines, _GROUPED_LINES), (degenerate_cells, _DEGENERATE_CELLS),
]
