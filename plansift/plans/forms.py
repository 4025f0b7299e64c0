"""Queries of typed fields, tags and views over title-block units made of ``part``, and over the texts of ``documents``.

Each part gives a unit in one of sixteen forms, so what an operator should read
out of it follows from the part's own columns; the SQL says that directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.functions.text import canonical_key, clauses, is_label, is_negated, is_noise, is_person, is_zone_marker, light_clean, of_kind, part_tokens, rejoin_continuations
from plansift.functions.vocabulary import CODES, bore_of, code_hits, fit_kind, forms, ra_of, vocabulary
from plansift.operators import documents as docs_
from plansift.operators.fields import PART_TYPES, STANDARD, buckets, material_class, parse_scale, parse_weight, standards, typed_record, typed_units
from plansift.operators.fingerprint import fingerprints
from plansift.operators.linkage import stands_free
from plansift.operators.tags import tag_units
from plansift.session import table, texts

# form: text, field and value, each an expression over the part's columns that both engines read
FORMS = [
    ("concat('Title: ', p_name)", "'part_name'", "p_name"),
    ("concat('Weight kg ', p_size, '.25')", "'weight'", "concat(p_size, '.25')"),
    ("concat('Total weight ', p_size, '00 g')", "'weight'", "concat(CAST(floor(p_size / 10) AS INT), '.', p_size % 10)"),
    ("concat('Mass: ', p_size, ',5 kg')", "'weight'", "concat(p_size, '.5')"),
    ("concat('Scale 1:', p_size)", "'scale'", "concat('1:', p_size)"),
    ("concat('Material: S355J2 ', p_brand, ' See note 3')", "'material'", "concat('S355J2 ', p_brand)"),
    ("concat('Coating: no coating on ', p_name)", "'coating'", "NULL"),
    ("concat('Coating: RAL 70', p_size)", "'coating'", "concat('RAL 70', p_size)"),
    ("'General tolerance ISO 2768-m'", "'general_tolerance'", "'ISO 2768-m'"),
    ("'Gen Tol added'", "'general_tolerance'", "NULL"),
    ("concat('Based on 3XABC', p_partkey)", "'based_on'", "concat('3XABC', p_partkey)"),
    ("'Based on'", "NULL", "NULL"),
    ("p_name", "NULL", "NULL"),
    ("'Specification: EN 10025 Scale 1:2'", "'specification'", "'EN 10025'"),
    ("concat('Finish: galvanized ', p_size)", "'coating'", "concat('galvanized ', p_size)"),
    ("'Werkstoff: 1.4301'", "'material'", "'1.4301'"),
]
_TEXT = "CASE p_partkey % 16 " + " ".join(f"WHEN {k} THEN {t}" for k, (t, _, _) in enumerate(FORMS)) + " END"


def _case(n: int) -> str:
    return "CASE p_partkey % 16 " + " ".join(f"WHEN {k} THEN {f[n]}" for k, f in enumerate(FORMS)) + " END"


_SAID = f"(SELECT p_partkey AS unit, p_brand AS stem, {_TEXT} AS text, {_case(1)} AS field, {_case(2)} AS value FROM part)"


def units(spark: SparkSession, sf: str) -> DataFrame:
    """``unit, position, stem, text``: a unit of each part; a document is the units of a brand."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_partkey").alias("position"), F.col("p_brand").alias("stem"), F.expr(_TEXT).alias("text"))


def typed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What each unit of a title block says under its label."""
    return typed_units(units(spark, sf)).select("unit", "field", "value")


_TYPED_FIELDS = f"SELECT unit, field, value FROM {_SAID}"


def typed_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row of fields for each document."""
    r = typed_record(typed_units(units(spark, sf)))
    return r.select("stem", *[F.array_join(c, "|").alias(c) for c in ("part_name", "scale", "material", "coating", "general_tolerance", "specification", "based_on", "part_type", "material_class", "standards")], "weight_kg")


_LISTS = ", ".join(f"coalesce(string_agg(value, '|' ORDER BY place) FILTER (field = '{f}'), '') AS {f}" for f in ("part_name", "scale", "material", "coating", "general_tolerance", "specification", "based_on"))
_TYPED_RECORDS = f"""
    WITH v AS (SELECT stem, field, value, min(unit) AS place FROM {_SAID} WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT DISTINCT p_brand AS stem FROM part),
         w AS (SELECT stem, arg_min(value, unit)::DOUBLE AS weight_kg FROM {_SAID} WHERE field = 'weight' GROUP BY stem),
         k AS (SELECT stem, 'part_type' AS kind, nullif(lower(regexp_extract(value, '(?i)\\b({"|".join(PART_TYPES)})s?\\b', 1)), '') AS value, place FROM v WHERE field = 'part_name'
               UNION ALL SELECT stem, 'material_class', CASE WHEN value = '1.4301' THEN 'stainless' ELSE 'steel' END, place FROM v WHERE field = 'material'
               UNION ALL SELECT stem, 'standards', CASE WHEN field = 'specification' THEN 'EN 10025' ELSE 'ISO 2768 m' END, place FROM v WHERE field IN ('specification', 'general_tolerance')),
         f AS (SELECT stem, kind, value, min(place) AS place FROM k WHERE value IS NOT NULL GROUP BY ALL),
         l AS (SELECT stem, kind, string_agg(value, '|' ORDER BY place) AS own FROM f GROUP BY ALL)
    SELECT s.stem, {_LISTS}, any_value(weight_kg) AS weight_kg, coalesce((SELECT own FROM l WHERE l.stem = s.stem AND kind = 'part_type'), '') AS part_type,
           coalesce((SELECT own FROM l WHERE l.stem = s.stem AND kind = 'material_class'), '') AS material_class, coalesce((SELECT own FROM l WHERE l.stem = s.stem AND kind = 'standards'), '') AS standards
    FROM s LEFT JOIN v ON s.stem = v.stem LEFT JOIN w ON s.stem = w.stem GROUP BY s.stem
"""

_AMOUNT = "CASE p_partkey % 8 WHEN 0 THEN concat(p_size, '.47 kg') WHEN 1 THEN concat('kg ', p_size) WHEN 2 THEN concat(p_size, '0 g') WHEN 3 THEN concat(p_size, ',5') WHEN 4 THEN concat(p_size, ' t') WHEN 5 THEN p_name WHEN 6 THEN concat('1:', p_size) ELSE concat(p_size, '/4') END"


def weights_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Weights in kilograms and scales of short texts."""
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("no"), F.expr(_AMOUNT).alias("text"))
    return d.select("no", parse_weight(F.col("text")).alias("kg"), parse_scale(F.col("text")).alias("scale"))


_WEIGHTS_SCALES = """
    SELECT p_partkey AS no, CASE p_partkey % 8 WHEN 0 THEN p_size + 0.47 WHEN 1 THEN p_size WHEN 2 THEN p_size / 100 WHEN 3 THEN p_size + 0.5 WHEN 4 THEN p_size * 1000 WHEN 5 THEN NULL WHEN 6 THEN 1 ELSE p_size END::DOUBLE AS kg,
           CASE p_partkey % 8 WHEN 6 THEN concat('1:', p_size) WHEN 7 THEN concat(p_size, ':4') END AS scale FROM part
"""


def unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that was understood of a document, counted by reason and name."""
    u = units(spark, sf)
    t = typed_units(u)
    tags = tag_units(t, vocabulary(spark)).withColumnRenamed("unit", "position").join(u.select("position", "stem"), "position")
    return docs_.unit_table(t, tags).filter("reason <> 'tag'").groupBy("stem", "reason", "name").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first"))


_CLASS_SQL = "CASE WHEN value = '1.4301' THEN 'stainless' WHEN value LIKE 'S355%' THEN 'steel' END"
_STANDARD_SQL = STANDARD.replace("'", "''")
_UNIT_ROWS = f"""
    WITH s AS (FROM {_SAID}), v AS (SELECT DISTINCT stem, field, value FROM s WHERE value IS NOT NULL AND field <> 'based_on'),
    d AS (SELECT DISTINCT stem, 'part_type' AS name, nullif(lower(regexp_extract(value, '(?i)\\b({"|".join(PART_TYPES)})s?\\b', 1)), '') AS text FROM v WHERE field = 'part_name'
          UNION SELECT DISTINCT stem, 'material_class', {_CLASS_SQL} FROM v WHERE field = 'material'),
    r AS (SELECT DISTINCT stem, unit, unnest(regexp_extract_all(text, '{_STANDARD_SQL}', 0)) AS ref FROM s),
    p AS (SELECT DISTINCT stem, upper(regexp_extract(ref, '{_STANDARD_SQL}', 1)) AS name, regexp_extract(ref, '{_STANDARD_SQL}', 2) AS number, regexp_extract(ref, '{_STANDARD_SQL}', 3) AS suffix FROM r),
    u AS (SELECT stem, 'named' AS reason, CASE WHEN field = 'weight' THEN 'weight_kg' ELSE field END AS name, value AS text FROM v
          UNION ALL SELECT stem, 'derived', name, text FROM d WHERE text IS NOT NULL
          UNION ALL SELECT stem, 'standard', name, name || ' ' || number || CASE WHEN suffix <> '' THEN '-' || suffix ELSE '' END FROM p)
    SELECT stem, reason, name, count(*) AS n, min(text) AS first FROM u GROUP BY ALL
"""


def prose_text(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of each unit in a sentence."""
    return docs_.prose(typed_record(typed_units(units(spark, sf).withColumn("stem", F.col("unit")))))


_PROSE_TEXT = f"""
    SELECT unit AS stem, CASE WHEN value IS NULL THEN '' WHEN field = 'part_name' THEN upper(value[1]) || lower(value[2:]) || '.' WHEN field = 'material' THEN 'Material: ' || value || '.'
           WHEN field = 'coating' THEN 'Surface treatment: ' || value || '.' WHEN field = 'general_tolerance' THEN 'General tolerance: ' || value || '.' WHEN field = 'scale' THEN 'Scale ' || value || '.'
           WHEN field = 'specification' THEN value ELSE '' END AS text FROM {_SAID}
"""

_CELL = "CASE p_partkey % 7 WHEN 0 THEN concat('Title: ', p_name) WHEN 1 THEN concat('approved by ', p_name) WHEN 2 THEN 'Virta Pekka' WHEN 3 THEN p_name WHEN 4 THEN concat('per ISO 5817 ', p_name) WHEN 5 THEN 'EF' ELSE concat('welding of ', p_name) END"
_BUCKET = "CASE WHEN p_size > 40 THEN 'bom' ELSE CASE p_partkey % 7 WHEN 0 THEN 'classified' WHEN 1 THEN 'debug' WHEN 2 THEN 'debug' WHEN 3 THEN CASE WHEN p_name LIKE '%bolt%' THEN 'classified' ELSE 'unclassified' END WHEN 4 THEN 'classified' WHEN 5 THEN 'debug' ELSE 'classified' END END"


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("stem"), F.expr(_CELL).alias("text"), (F.col("p_size") > 40).alias("is_bom"), F.when(F.col("p_partkey") % 2 == 0, "block").otherwise("body").alias("src"))
    tagged = tag_units(u, vocabulary(spark)).select("unit").distinct().withColumn("has_tag", F.lit(True))
    return buckets(u.join(tagged, "unit", "left"), F.coalesce(F.col("has_tag"), F.lit(False)))


def bucket_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit in exactly one bucket."""
    return _bucketed(spark, sf).select("unit", "bucket")


_BUCKET_PARTITION = f"SELECT p_partkey AS unit, {_BUCKET} AS bucket FROM part"


def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many units of each document are in each bucket."""
    return docs_.unit_counts(_bucketed(spark, sf))


_BUCKET_COUNTS = f"""
    SELECT p_brand AS stem, count(*) FILTER (b = 'classified') AS n_classified, count(*) FILTER (b = 'unclassified') AS n_unclassified, count(*) FILTER (b = 'debug') AS n_debug, count(*) FILTER (b = 'bom') AS n_bom, count(*) AS n_units
    FROM (SELECT p_brand, {_BUCKET} AS b FROM part) GROUP BY 1
"""


def fingerprint_text(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint text of each document; nothing of the bill of material is in it."""
    return fingerprints(_bucketed(spark, sf).select("stem", F.col("unit").alias("position"), "bucket", "src", "text", "field", "value", F.lit(False).alias("noise")))


_FINGERPRINT_TEXT = f"""
    WITH c AS (SELECT p_brand AS stem, p_partkey AS no, p_partkey % 7 AS k, p_name, {_CELL} AS text, {_BUCKET} AS b FROM part),
         r AS (SELECT stem, 0 AS part, no, text FROM c WHERE b = 'unclassified' OR b = 'classified' AND k <> 0 UNION ALL SELECT stem, 2, no, p_name || ' field_part_name' FROM c WHERE k = 0 AND b <> 'bom')
    SELECT s.stem, coalesce(string_agg(r.text, ' ' ORDER BY part, no), '') AS text FROM (SELECT DISTINCT stem FROM c) s LEFT JOIN r ON r.stem = s.stem GROUP BY 1
"""

# ---------------------------------------------------------------- texts of documents

#: Every document with references and codes written after its own text; both engines read the expression.
_NOTED = (
    "concat(coalesce(text, ''), ' See ISO ', 1000 + doc_id % 90, '-mK, DIN ', 100 + doc_id % 7, ' No paint on M', 4 + doc_id % 20, 'x1,5 threads. Ra ', doc_id % 9, ',2 S355J2+N IP5', doc_id % 6, ' iso 5817-C H7/g6 RAL ', 7000 + doc_id % 50, ' shot blasted 62', 10 + doc_id % 8, '-2RS NU', 200 + doc_id % 9, ' EN AW-60', 10 + doc_id % 80, ' GJS-', 400 + doc_id % 2, ' POM-C FEM 2m IM B', doc_id % 9, ' duty S', 1 + doc_id % 11, ' ISO 12944-2 C', doc_id % 7, ' Fe/Zn', 12)"
)


def _noted(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", F.expr(_NOTED).alias("text"))


_NOTES = f"(SELECT doc_id, {_NOTED} AS text FROM documents)"


def standards_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Standards that documents name, once each."""
    return standards(_noted(spark, sf), "doc_id").withColumnRenamed("unit", "doc_id")


_STANDARDS_REFS = f"""
    SELECT DISTINCT doc_id, upper(regexp_extract(ref, '{_STANDARD_SQL}', 1)) AS family, regexp_extract(ref, '{_STANDARD_SQL}', 2) AS number, regexp_extract(ref, '{_STANDARD_SQL}', 3) AS suffix
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_STANDARD_SQL}', 0)) AS ref FROM {_NOTES})
"""


def standards_context(spark: SparkSession, sf: str) -> DataFrame:
    """Standards with what stands around them."""
    return docs_.standards_in_context(_noted(spark, sf), "doc_id", "text")


_STANDARDS_CONTEXT = f"""
    WITH r AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_STANDARD_SQL}', 0)) AS ref, generate_subscripts(regexp_extract_all(text, '{_STANDARD_SQL}', 0), 1) AS no FROM {_NOTES}),
         c AS (SELECT doc_id, no, ref, upper(regexp_extract(ref, '{_STANDARD_SQL}', 1)) AS family, regexp_extract(ref, '{_STANDARD_SQL}', 2) AS number, regexp_extract(ref, '{_STANDARD_SQL}', 3) AS suffix, text, strpos(text, ref) AS place FROM r)
    SELECT doc_id AS id, family, number, suffix, trim(replace(arg_min(substr(text, greatest(place - 5, 1), place - greatest(place - 5, 1) + length(ref) + 30), no), chr(10), ' ')) AS context FROM c GROUP BY ALL
"""


def structured_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Structured codes of each document."""
    return _noted(spark, sf).select("doc_id", *code_hits("text"))


_STRUCTURED_CODES = "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{n}" for n, p in CODES.items()) + f" FROM {_NOTES}"


def clause_negation(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of every document, and whether they are negated."""
    d = _noted(spark, sf).select("doc_id", F.posexplode(clauses(F.col("text"))).alias("no", "clause"))
    return d.select("doc_id", "no", F.md5("clause").alias("clause_md5"), is_negated(F.col("clause")).alias("negated"))


#: DuckDB's word boundaries know ASCII alone: letters beyond it are set between letters while clauses are looked for.
_SPLIT_AT = r"(?i)(\bNot\b|\bNo\b|NOTE!|\bSee\b|Surface treatment)"


def _clauses_sql(text: str) -> str:
    """SQL for the clauses of a text, each with its letters beyond ASCII still set apart."""
    apart = rf"regexp_replace({text}, '([^\x00-\x7F])', 'qzxj\1qzxj', 'g')"
    return rf"list_filter(list_transform(string_split(regexp_replace({apart}, '{_SPLIT_AT}', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def _joined_sql(clause: str) -> str:
    return rf"regexp_replace({clause}, 'qzxj([^\x00-\x7F])qzxj', '\1', 'g')"


_CLAUSE_NEGATION = rf"""
    WITH c AS (SELECT doc_id, {_clauses_sql('text')} AS cs FROM {_NOTES})
    SELECT doc_id, i - 1 AS no, md5({_joined_sql('cs[i]')}) AS clause_md5, regexp_matches(cs[i], '(?i)^(no|not|without)\b') AS negated FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)
"""

_LINES = "concat('Order No: ', doc_id, '    see back', chr(10), 'Scale:  1:', doc_id % 20, chr(10), coalesce(text, ''), chr(10), 'Order No: 999', chr(10), '  RAL: RAL ', 7000 + doc_id % 50, ', ral-9005')"


def key_value_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of label and value; the first of a label counts."""
    return docs_.key_values(texts(spark, sf).select("doc_id", F.expr(_LINES).alias("text")), "doc_id", "text")


_KV = docs_.KEY_VALUE
_KEY_VALUE_LINES = f"""
    WITH m AS (SELECT doc_id, regexp_extract_all({_LINES}, '{_KV}', 0) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM m),
         f AS (SELECT doc_id, no, upper(trim(regexp_extract(line, '{_KV}', 1))) AS field, trim(regexp_extract(regexp_extract(line, '{_KV}', 2), '^(.*?)(?: {{4,}}.*)?$', 1)) AS value FROM l)
    SELECT doc_id AS id, field, arg_min(value, no) AS value FROM f GROUP BY ALL
"""


def colours_treatments(spark: SparkSession, sf: str) -> DataFrame:
    """Colour codes and treatment words of each document."""
    return _noted(spark, sf).select("doc_id", F.array_join(docs_.ral_codes(F.col("text")), ",").alias("ral"), F.array_join(docs_.treatments(F.col("text")), ",").alias("treatments"))


_COLOURS_TREATMENTS = f"""
    SELECT doc_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '{docs_.RAL}', 1))), 'string_agg', ',') AS ral,
           list_aggregate(list_filter([{", ".join(f"'{t}'" for t in docs_.TREATMENTS)}], lambda t: contains(upper(text), t)), 'string_agg', ',') AS treatments FROM {_NOTES}
"""



def _words(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(F.explode(F.split("text", r"[\t\n\x0b\f\r ]+")).alias("word")).filter("word <> ''").distinct()


_WORDS = r"(SELECT DISTINCT unnest(string_split_regex(text, '[\t\n\x0b\f\r ]+')) AS word FROM documents)"


def unit_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Zone markers, persons, labels and noise among all words of documents."""
    c = F.col("word")
    return _words(spark, sf).select("word", is_zone_marker(c).alias("zone"), is_person(c).alias("person"), is_label(c).alias("label"), is_noise(of_kind(light_clean(c), "kept"), F.lit(0)).alias("noise"))


_UNIT_PREDICATES = rf"""
    SELECT word, regexp_matches(word, '^[\p{{L}}\p{{N}}]$') OR regexp_matches(word, '^\d{{1,2}}$') AS zone, regexp_matches(word, '^[A-ZÄÖÅ]{{1,3}}$') OR regexp_matches(word, '^[a-zäöå]{{3,}}[0-9]{{1,3}}$') AS person,
      length(word) BETWEEN 2 AND 30 AND len(regexp_extract_all(word, '\p{{L}}')) > 0 AND len(regexp_extract_all(word, '\p{{Lu}}')) >= 0.8 * len(regexp_extract_all(word, '\p{{L}}')) AS label,
      NOT (NOT regexp_matches(word, '[^\x00-\x7F]') AND NOT regexp_matches(word, '^[OoＯ0oº]+$') AND NOT regexp_matches(word, '^[^\p{{L}}\p{{N}}_]+$') AND NOT regexp_matches(word, '^[+\-]\d+(?:[.,]\d+)?$')
           AND NOT regexp_matches(word, '^[R⌀ØøΦϕ(]?\s?\d+(?:[.,]\d+)?(?:\s?[x×]\s?\d+)?\)?(?:mm|MM|pcs|PCS|°)?$') AND length(regexp_replace(regexp_replace(word, '^[.,:;()\-]+', ''), '[.,:;()\-]+$', '')) >= 2 AND length(word) >= 4) AS noise
    FROM {_WORDS} WHERE word <> ''
"""


def token_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and keys of all words of documents, and words put together across lines."""
    c = F.concat("word", F.lit("-PL10/"), "word", F.lit(",5:"))
    return _words(spark, sf).select("word", F.array_join(part_tokens(c), "|").alias("parts"), canonical_key(c).alias("key"), rejoin_continuations(F.concat("word", F.lit("-\n ing"))).alias("joined"))


_TOKEN_KEYS = rf"""
    SELECT word, list_aggregate(list_filter(string_split_regex(t, '[-/]'), lambda p: p <> ''), 'string_agg', '|') AS parts, regexp_replace(regexp_replace(replace(lower(t), ',', '.'), '[\s\-_/]+', '', 'g'), '[:;,.]+$', '') AS key,
           regexp_replace(word || '-' || chr(10) || ' ing', '(\p{{L}})-\s*\n\s*(\p{{Ll}})', '\1\2', 'g') AS joined FROM (SELECT word, word || '-PL10/' || word || ',5:' AS t FROM {_WORDS} WHERE word <> '')
"""


def boundary_search(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the item of a made-up number stands free in each document."""
    d = texts(spark, sf).select("doc_id", F.expr("concat(coalesce(text, ''), CASE doc_id % 4 WHEN 0 THEN concat(' b', doc_id, '.c d') WHEN 1 THEN concat('xb', doc_id, '.c') WHEN 2 THEN concat(' (b', doc_id, '.c)') ELSE concat(' b', doc_id, 'xc') END)").alias("text"))
    return d.select("doc_id", stands_free(F.col("text"), F.concat(F.lit("b"), F.col("doc_id").cast("string"), F.lit(".c"))).alias("found"))


_BOUNDARY_SEARCH = "SELECT doc_id, doc_id % 4 IN (0, 2) AS found FROM documents"


def tag_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary tags of every document with a note after it, counted by category, anchor and negation."""
    own = texts(spark, sf).select(F.col("doc_id").alias("unit"), F.concat(F.coalesce("text", F.lit("")), F.lit(" No hot dip galvanized "), F.when(F.col("doc_id") % 2 == 0, "welded").otherwise("flatness")).alias("text"))
    tags = tag_units(own, vocabulary(spark)).filter(~F.col("category").isin("process", "weld_quality", "fits"))
    return tags.groupBy("category", F.upper("anchor").alias("anchor"), "negated").agg(F.countDistinct("unit").alias("n"))


_FORM_ROWS = ", ".join("('" + f[0].replace("'", "''") + "', '" + {"corrosion": "surface", "surface_texture": "surface"}.get(f[1], f[1]) + "')" for f in forms())
_TAG_DICTIONARY = rf"""
    WITH v AS (SELECT DISTINCT form, category FROM (VALUES {_FORM_ROWS}) AS f(form, category) WHERE category NOT IN ('weld_quality', 'fits')),
    k AS (SELECT doc_id AS unit, unnest({_clauses_sql("coalesce(text, '') || ' No hot dip galvanized ' || CASE WHEN doc_id % 2 = 0 THEN 'welded' ELSE 'flatness' END")}) AS own FROM documents),
    c AS (SELECT unit, regexp_matches(own, '(?i)^(no|not|without)\b') AS negated, {_joined_sql('own')} AS clause FROM k),
    t AS (SELECT unit, clause, negated, list_filter(string_split_regex(replace(clause, ',', ' '), '\s+'), lambda x: x <> '') AS w FROM c),
    g AS (SELECT DISTINCT unit, negated, unnest(list_transform(range(1, len(w) - n + 2), lambda i: upper(array_to_string(w[i:i + n - 1], ' ')))) AS anchor FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)),
    s AS (SELECT DISTINCT unit, negated, upper(unnest(list_filter([regexp_extract(clause, '(?i)\bRAL[\s-]?\d{{3,4}}\b', 0), regexp_extract(clause, '(?i)surface treatment|paint system|coating|primer', 0)], lambda x: x <> ''))) AS anchor FROM t),
    d AS (SELECT unit, negated, category, anchor FROM g JOIN v ON anchor = form UNION SELECT unit, negated, 'surface', anchor FROM s)
    SELECT category, anchor, negated, count(DISTINCT unit) AS n FROM d GROUP BY ALL
"""


def code_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Bores, kinds of fit and roughness behind codes made of part sizes."""
    p = table(spark, sf, "part").select("p_partkey", F.lpad(F.col("p_size").cast("string"), 2, "0").alias("bore"), F.concat(F.lit("H7/"), F.expr("substr('abcdefghijklmnopqrstuvwxyz', p_size % 26 + 1, 1)"), F.lit("6")).alias("fit"), F.concat(F.lit("N"), (F.col("p_size") % 14).cast("string")).alias("n"))
    return p.select("p_partkey", bore_of(F.col("bore")).alias("mm"), fit_kind(F.col("fit")).alias("kind"), F.round(ra_of(F.col("n")), 3).alias("ra"))


_CODE_LOOKUPS = """
    SELECT p_partkey, CASE p_size WHEN 0 THEN 10 WHEN 1 THEN 12 WHEN 2 THEN 15 WHEN 3 THEN 17 ELSE p_size * 5 END AS mm, CASE WHEN p_size % 26 < 8 THEN 'clearance' WHEN p_size % 26 < 14 THEN 'transition' ELSE 'interference' END AS kind,
           CASE WHEN p_size % 14 BETWEEN 1 AND 8 THEN round(0.025 * 2 ** (p_size % 14 - 1), 3) WHEN p_size % 14 BETWEEN 9 AND 12 THEN [6.3, 12.5, 25.0, 50.0][p_size % 14 - 8] END::DOUBLE AS ra FROM part
"""


def material_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of material by the first pattern that matches."""
    d = table(spark, sf, "part").select("p_partkey", F.expr("concat(p_name, CASE p_size % 6 WHEN 0 THEN ' S355J2' WHEN 1 THEN ' AISI 304' WHEN 2 THEN ' EN AW aluminium steel' WHEN 3 THEN ' POM' WHEN 4 THEN ' HDG steel' ELSE ' wood' END)").alias("text"))
    return d.select("p_partkey", material_class(F.col("text")).alias("class"))


_MATERIAL_CLASSES = "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'steel' WHEN 1 THEN 'stainless' WHEN 2 THEN 'aluminium' WHEN 3 THEN 'plastic' WHEN 4 THEN 'galv_steel' END AS class FROM part"

PAIRS = [
    (typed_fields, _TYPED_FIELDS), (typed_records, _TYPED_RECORDS), (weights_scales, _WEIGHTS_SCALES), (unit_rows, _UNIT_ROWS), (prose_text, _PROSE_TEXT), (bucket_partition, _BUCKET_PARTITION), (bucket_counts, _BUCKET_COUNTS),
    (fingerprint_text, _FINGERPRINT_TEXT), (standards_refs, _STANDARDS_REFS), (standards_context, _STANDARDS_CONTEXT), (structured_codes, _STRUCTURED_CODES), (clause_negation, _CLAUSE_NEGATION), (key_value_lines, _KEY_VALUE_LINES),
    (colours_treatments, _COLOURS_TREATMENTS), (unit_predicates, _UNIT_PREDICATES), (token_keys, _TOKEN_KEYS), (boundary_search, _BOUNDARY_SEARCH), (tag_dictionary, _TAG_DICTIONARY), (code_lookups, _CODE_LOOKUPS), (material_classes, _MATERIAL_CLASSES),
]
