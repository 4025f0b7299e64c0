"""Queries of linkage, bills of material and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.functions.text import token_kind, tokens, undouble, without_stop_words
from plansift.operators import stats
from plansift.operators.evaluate import group_vote_counts, group_votes, overlap, summary
from plansift.operators.features import frequent_lines
from plansift.operators.fields import PART_TYPES, part_type
from plansift.operators.fingerprint import first_on_page
from plansift.operators.linkage import family, link, link_heads, reach
from plansift.operators.models import frequent_labels
from plansift.session import small, table, texts


def _files(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.concat((F.col("p_partkey") + 1000000).cast("string"), F.lit("_"), "p_name", F.lit(".pdf")).alias("stem"))


def linkage_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Files linked to items by a key that equals a head of the description."""
    p = table(spark, sf, "part")
    d = F.concat((F.col("p_partkey") + 1000000).cast("string"), F.when(F.col("p_size") > 25, "B").otherwise(""), F.lit("--"), "p_type")
    return link_heads(_files(spark, sf), p.select(F.col("p_partkey").alias("item"), d.alias("description")))


_LINKAGE_HEADS = """
    WITH f AS (SELECT (p_partkey + 1000000)::VARCHAR || '_' || p_name || '.pdf' AS stem, (p_partkey + 1000000)::VARCHAR AS id FROM part),
         k AS (SELECT stem, id || s AS key FROM f, (SELECT unnest(['', 'A', 'B', 'C', 'D', 'E', 'F', '-A', '-B', '-C']) AS s)),
         i AS (SELECT p_partkey AS item, (p_partkey + 1000000)::VARCHAR || CASE WHEN p_size > 25 THEN 'B' ELSE '' END AS key FROM part)
    SELECT DISTINCT stem, item FROM k JOIN i USING (key)
"""


def linkage_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Files without a head, linked by a key inside the description between non-alphanumerics."""
    p = table(spark, sf, "part")
    id_ = (F.col("p_partkey") + 1000000).cast("string")
    d = F.when(F.col("p_size") > 40, F.concat(id_, F.lit("--"), "p_type")).when(F.col("p_size") > 20, F.concat(F.lit("spare "), "p_name", F.lit(" ("), id_, F.lit(") "), "p_type")).otherwise(F.concat(F.lit("spare x"), id_))
    return link(_files(spark, sf), p.select(F.col("p_partkey").alias("item"), d.alias("description")))


_LINKAGE_FALLBACK = """
    WITH p AS (SELECT *, (p_partkey + 1000000)::VARCHAR AS id FROM part),
         i AS (SELECT p_partkey AS item, id AS own, CASE WHEN p_size > 40 THEN 'head' WHEN p_size > 20 THEN 'inside' END AS how FROM p)
    SELECT id || '_' || p_name || '.pdf' AS stem, item, how FROM p JOIN i ON id = own WHERE how IS NOT NULL
"""


def bom_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of each order one hop down, once each."""
    lines = table(spark, sf, "lineitem")
    linked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stem"), F.col("o_orderkey").alias("item"))
    found = reach(linked, lines, "l_orderkey", "l_partkey", "component")
    return found.groupBy("stem").agg(F.count(F.lit(1)).alias("n_components"), F.min("component").alias("first_component"), F.max("component").alias("last_component"))


_BOM_COMPONENTS = """
    SELECT o_orderkey AS stem, count(DISTINCT l_partkey) AS n_components, min(l_partkey) AS first_component, max(l_partkey) AS last_component
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
"""


def prod_line_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Production lines of each order that are frequent enough to be learnt."""
    centers = table(spark, sf, "supplier").join(small(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("label"))
    labelled = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(centers, F.col("l_suppkey") == F.col("s_suppkey")).filter("label <> ''").select(F.col("l_orderkey").alias("stem"), "label").distinct()
    # a label set is small by nature: lines, not documents
    return labelled.join(frequent_labels(labelled, "stem", "label", 20).select("label"), "label", "left_semi").select("stem", "label")


_PROD_LINE_LABELS = """
    WITH l AS (SELECT DISTINCT l_orderkey AS stem, n_name AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
    SELECT stem, label FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 20)
"""


def family_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """One family of each order, the least where there are several."""
    o = table(spark, sf, "orders")
    linked = o.select(F.col("o_orderkey").alias("stem"), F.col("o_custkey").alias("item"))
    return family(linked, table(spark, sf, "customer").select(F.col("c_custkey").alias("item"), "c_mktsegment"), "c_mktsegment")


_FAMILY_OF_ORDER = "SELECT o_orderkey AS stem, min(c_mktsegment) AS family FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> '' GROUP BY 1"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("component")).distinct()


def item_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Items by their place in the bill of material, with shares."""
    classes = stats.item_classes(_edges(spark, sf), table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("item")))
    counted = stats.with_share(classes.groupBy("class").agg(F.count(F.lit(1)).alias("n")))
    return counted.select("class", "n", F.round("share", 6).alias("share"))


_CLASSES = """
    WITH i AS (SELECT p_partkey AS item FROM part WHERE p_size <= 40),
         p AS (SELECT DISTINCT l_suppkey AS item FROM lineitem), c AS (SELECT DISTINCT l_partkey AS item FROM lineitem),
         a AS (SELECT item FROM i UNION SELECT item FROM p UNION SELECT item FROM c),
         k AS (SELECT item, CASE WHEN item NOT IN (SELECT item FROM i) THEN 'external'
                    WHEN item IN (SELECT item FROM p) AND item NOT IN (SELECT item FROM c) THEN 'top_level'
                    WHEN item IN (SELECT item FROM p) THEN 'subassembly'
                    WHEN item IN (SELECT item FROM c) THEN 'leaf' ELSE 'uninstantiated' END AS class FROM a)
"""
_ITEM_BUCKETS = _CLASSES + "SELECT class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY class"


def pdf_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by the richest class among their items."""
    classes = stats.item_classes(_edges(spark, sf), table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("item")))
    linked = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stem"), F.col("l_partkey").alias("item")).distinct()
    return stats.richest_class(linked, classes)


_PDF_BUCKETS = _CLASSES + """
    , r AS (SELECT l_orderkey AS stem, class, CASE class WHEN 'top_level' THEN 4 WHEN 'subassembly' THEN 3 WHEN 'leaf' THEN 2 WHEN 'uninstantiated' THEN 1 ELSE 0 END AS pri
            FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN k ON item = l_partkey)
    SELECT stem, arg_max(class, pri) AS class FROM r GROUP BY stem
"""


def top_level_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parents that are a component of nothing."""
    e = _edges(spark, sf)
    return e.select(F.col("parent").alias("item")).subtract(e.select(F.col("component").alias("item")))


_TOP_LEVEL_PARENTS = "SELECT l_suppkey AS item FROM lineitem EXCEPT SELECT l_partkey FROM lineitem"


def singleton_share(spark: SparkSession, sf: str) -> DataFrame:
    """How many components (part and supplier) are in one order only."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey").alias("component"))
    df = stats.document_frequency(lines, "l_orderkey", "component")
    one = F.sum((F.col("parents") == 1).cast("int"))
    return df.agg(F.count(F.lit(1)).alias("n_components"), one.alias("n_singleton"), F.round(one / F.count(F.lit(1)), 6).alias("share"))


_SINGLETON_SHARE = """
    WITH d AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS parents FROM lineitem GROUP BY ALL)
    SELECT count(*) AS n_components, sum((parents = 1)::INT)::BIGINT AS n_singleton, round(sum((parents = 1)::INT) / count(*), 6) AS share FROM d
"""


def histogram_components(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by their number of components, over two sets of edges."""
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n"))
    a = stats.histogram(n, "n", stats.COMPONENT_EDGES).withColumn("edges", F.lit("components"))
    return a.unionByName(stats.histogram(n, "n", stats.COVERAGE_EDGES).withColumn("edges", F.lit("coverage")))


_HISTOGRAM_COMPONENTS = """
    WITH d AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 7 THEN '4-7' WHEN n <= 15 THEN '8-15' ELSE '16+' END AS bucket, count(*) AS n, 'components' AS edges FROM d GROUP BY 1
    UNION ALL
    SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 50 THEN '21-50' ELSE '50+' END, count(*), 'coverage' FROM d GROUP BY 1
"""


def quartiles_words(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles of words per document by language, as values at ``floor(p n)``."""
    d = texts(spark, sf).select("lang", F.size(tokens(F.col("text"))).cast("long").alias("words"))
    return stats.quartiles_by_index(d, "words", ["lang"])


_QUARTILES_WORDS = r"""
    WITH d AS (SELECT lang, len(list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) AS w FROM documents),
         s AS (SELECT lang, list_sort(list(w)) AS l, count(*) AS n FROM d GROUP BY lang)
    SELECT lang, l[1 + floor(0.25 * n)::INT]::BIGINT AS p25, l[1 + floor(0.5 * n)::INT]::BIGINT AS p50, l[1 + floor(0.75 * n)::INT]::BIGINT AS p75, n FROM s
"""


def composition_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, mean size and share with several lines, for everything and each source."""
    d = texts(spark, sf).withColumn("several", F.contains("text", F.lit("\n")).cast("int"))
    d.createOrReplaceTempView("plansift_composition")
    out = spark.sql("SELECT source, count(*) AS docs, round(avg(n_chars), 6) AS mean_chars, round(avg(several), 6) AS several_lines FROM plansift_composition GROUP BY GROUPING SETS ((), (source))")
    return out.select(F.coalesce("source", F.lit("ALL")).alias("source"), "docs", "mean_chars", "several_lines")


_COMPOSITION_BY_SOURCE = """
    SELECT coalesce(source, 'ALL') AS source, count(*) AS docs, round(avg(n_chars), 6) AS mean_chars, round(avg(contains(text, chr(10))::INT), 6) AS several_lines
    FROM documents GROUP BY GROUPING SETS ((), (source))
"""


def work_content(spark: SparkSession, sf: str) -> DataFrame:
    """Work of each order over four columns, kept above 0, and its mean by customer."""
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") + F.col("l_extendedprice") + F.col("l_discount") + F.col("l_tax")).alias("work")).filter("work > 0")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(per, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.round(F.avg("work"), 4).alias("mean_work"), F.count(F.lit(1)).alias("orders"))


_WORK_CONTENT = """
    WITH w AS (SELECT l_orderkey, sum(l_quantity + l_extendedprice + l_discount + l_tax) AS work FROM lineitem GROUP BY 1 HAVING sum(l_quantity + l_extendedprice + l_discount + l_tax) > 0)
    SELECT o_custkey, round(avg(work), 4) AS mean_work, count(*) AS orders FROM orders JOIN w ON o_orderkey = l_orderkey GROUP BY 1
"""


def _line_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Supplier nations of each order: its own, and those of two or more other orders of its customer."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    own = line.select(F.col("l_orderkey").alias("query"), F.col("s_nationkey").alias("value")).distinct()
    members = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), "o_custkey")
    return own, group_votes(members, own, "o_custkey", 2)


_LINE_SETS = """
    WITH own AS (SELECT DISTINCT l_orderkey AS query, s_nationkey AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
         pairs AS (SELECT a.o_orderkey AS query, b.o_orderkey AS candidate FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey),
         pred AS (SELECT pairs.query, value, count(*) AS votes FROM pairs JOIN own ON own.query = candidate GROUP BY ALL HAVING count(*) >= 2),
         c AS (SELECT coalesce(o.query, p.query) AS query, count(o.value) AS t, count(p.value) AS p, count(CASE WHEN o.value IS NOT NULL AND p.value IS NOT NULL THEN 1 END) AS b
               FROM own o FULL JOIN pred p ON o.query = p.query AND o.value = p.value GROUP BY 1 HAVING count(o.value) > 0)
"""


def offby_k(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by the number of labels in which their own and the proposed set differ."""
    own, pred = _line_sets(spark, sf)
    return overlap(own, pred).groupBy("off_by").agg(F.count(F.lit(1)).alias("n"))


_OFFBY_K = _LINE_SETS + "SELECT t + p - 2 * b AS off_by, count(*) AS n FROM c GROUP BY 1"


def set_overlap_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All set measures over orders, each under its own name."""
    own, pred = _line_sets(spark, sf)
    agg = overlap(own, pred).agg(*summary())
    return agg.select("n", *[F.round(c, 6).alias(c) for c in agg.columns if c != "n"])


_SET_OVERLAP_METRICS = _LINE_SETS + """
    SELECT count(*) AS n, round(avg(CASE WHEN p = 0 THEN 0 ELSE b / p END), 6) AS mean_precision, round(avg(b / t), 6) AS mean_recall, round(avg(2 * b / (t + p)), 6) AS sample_f1,
           round(avg(b / (t + p - b)), 6) AS mean_jaccard, round(avg((b > 0)::INT), 6) AS hit_rate, round(avg((b = t + p - b)::INT), 6) AS exact_match,
           round(sum(b) / sum(p), 6) AS micro_precision, round(sum(b) / sum(t), 6) AS micro_recall, round(2 * sum(b) / (sum(t) + sum(p)), 6) AS micro_f1,
           round(avg((t + p - 2 * b <= 1)::INT), 6) AS off_by_1, round(avg((t + p - 2 * b <= 2)::INT), 6) AS off_by_2
    FROM c
"""


def group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Exactness, micro F1 and Jaccard over everything and by order priority."""
    own, pred = _line_sets(spark, sf)
    rows = overlap(own, pred).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), "o_orderpriority"), "query")
    out = rows.rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("exact"), 6).alias("exact"), F.round(2 * F.sum("n_both") / (F.sum("n_pred") + F.sum("n_true")), 6).alias("micro_f1"), F.round(F.avg("jaccard"), 6).alias("jaccard"))
    return out.select(F.coalesce("o_orderpriority", F.lit("ALL")).alias("part"), "n", "exact", "micro_f1", "jaccard")


_GROUP_METRICS = _LINE_SETS + """
    SELECT coalesce(o_orderpriority, 'ALL') AS part, count(*) AS n, round(avg((b = t + p - b)::INT), 6) AS exact, round(2 * sum(b) / (sum(t) + sum(p)), 6) AS micro_f1, round(avg(b / (t + p - b)), 6) AS jaccard
    FROM c JOIN orders ON o_orderkey = query GROUP BY ROLLUP (o_orderpriority)
"""


def bom_nonunique_micro(spark: SparkSession, sf: str) -> DataFrame:
    """Micro precision, recall and F1 of proposed components, over all and over those in two orders or more."""
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("value")).distinct()
    members = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), "o_custkey")
    df = own.groupBy("value").agg(F.count(F.lit(1)).alias("df"))
    scoped = own.join(df, "value").withColumn("scope", F.explode(F.when(F.col("df") >= 2, F.array(F.lit("all"), F.lit("recurring"))).otherwise(F.array(F.lit("all")))))
    out = group_vote_counts(members, scoped, "o_custkey")
    p, r = F.col("n_both") / F.col("n_pred"), F.col("n_both") / F.col("n_true")
    return out.select("scope", "n_true", "n_pred", "n_both", F.round(p, 6).alias("micro_precision"), F.round(r, 6).alias("micro_recall"), F.round(2 * F.col("n_both") / (F.col("n_true") + F.col("n_pred")), 6).alias("micro_f1"))


_BOM_NONUNIQUE_MICRO = """
    WITH own AS (SELECT DISTINCT l_orderkey AS query, l_partkey AS value FROM lineitem),
         pairs AS (SELECT a.o_orderkey AS query, b.o_orderkey AS candidate FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey),
         pred AS (SELECT DISTINCT pairs.query, value FROM pairs JOIN own ON own.query = candidate),
         two AS (SELECT value FROM own GROUP BY value HAVING count(*) >= 2),
         s AS (SELECT 'all' AS scope, query, value, 't' AS k FROM own UNION ALL SELECT 'all', query, value, 'p' FROM pred
               UNION ALL SELECT 'recurring', query, value, 't' FROM own WHERE value IN (FROM two) UNION ALL SELECT 'recurring', query, value, 'p' FROM pred WHERE value IN (FROM two)),
         e AS (SELECT scope, query, value, count(*) FILTER (k = 't') AS t, count(*) FILTER (k = 'p') AS p FROM s GROUP BY ALL),
         c AS (SELECT scope, query, sum(t) AS t, sum(p) AS p, sum(t * p) AS b FROM e GROUP BY ALL HAVING sum(t) > 0)
    SELECT scope, sum(t)::BIGINT AS n_true, sum(p)::BIGINT AS n_pred, sum(b)::BIGINT AS n_both, round(sum(b) / sum(p), 6) AS micro_precision, round(sum(b) / sum(t), 6) AS micro_recall, round(2 * sum(b) / (sum(t) + sum(p)), 6) AS micro_f1 FROM c GROUP BY scope
"""


def vote_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components that two or more other orders of a customer have, by votes."""
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("value")).distinct()
    return group_votes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), "o_custkey"), own, "o_custkey", 2)


_VOTE_COMPONENTS = """
    WITH own AS (SELECT DISTINCT l_orderkey AS query, l_partkey AS value FROM lineitem)
    SELECT a.o_orderkey AS query, value, count(*) AS votes FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey JOIN own ON own.query = b.o_orderkey
    GROUP BY ALL HAVING count(*) >= 2
"""


def component_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many components have a drawing of their own: a semi-join."""
    c = table(spark, sf, "lineitem").select("l_partkey").distinct()
    drawn = table(spark, sf, "part").filter("p_size > 10").select("p_partkey")
    have = c.join(drawn, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return c.agg(F.count(F.lit(1)).alias("components")).crossJoin(have.agg(F.count(F.lit(1)).alias("drawn"))).select("components", "drawn", F.round(F.try_divide("drawn", "components"), 6).alias("share"))


_COMPONENT_COVERAGE = """
    WITH c AS (SELECT DISTINCT l_partkey FROM lineitem)
    SELECT count(*) AS components, count(*) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS drawn, round(count(*) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)) / count(*), 6) AS share FROM c
"""


def line_df_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stand in more than half a percent of the documents."""
    lines = texts(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return frequent_lines(lines, "doc_id", "line", 0.005)


_LINE_DF_FILTER = r"""
    WITH l AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(u), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents))
    SELECT line, count(*) AS df FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 0.005 * (SELECT count(DISTINCT doc_id) FROM documents)
"""


def crosspage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of conversations that are on no earlier turn; repeats within a turn stay."""
    lines = texts(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return first_on_page(lines, "conv_id", "turn", F.trim(F.lower("line"))).select("conv_id", "turn", "no", "line")


_CROSSPAGE_DEDUP = """
    WITH l AS (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10)))))::INT AS no, unnest(string_split(text, chr(10))) AS line FROM conversations)
    SELECT conv_id, turn, no, line FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, trim(lower(line))) AS f FROM l) WHERE turn = f
"""


def undouble_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that two layers of a page print twice, put right."""
    p = table(spark, sf, "part")
    t = F.when(F.col("p_size") > 25, F.concat_ws(" ", "p_name", "p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type", "p_name"))
    return p.select("p_partkey", undouble(t).alias("text"))


_UNDOUBLE_NAMES = "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' ' || p_type || ' ' || p_name END AS text FROM part"


def light_clean_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each kind that light cleaning tells apart, by language."""
    d = texts(spark, sf).select("lang", F.explode(tokens(F.col("text"))).alias("t"))
    return d.groupBy("lang", token_kind(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_LIGHT_CLEAN_COUNTS = r"""
    WITH t AS (SELECT lang, unnest(list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) AS t FROM documents)
    SELECT lang, CASE WHEN regexp_matches(t, '[^\x00-\x7F]') THEN 'non_ascii_symbol' WHEN regexp_full_match(t, '[Oo0]+') THEN 'o_run_holes'
           WHEN regexp_full_match(t, '[^A-Za-z0-9_]+') THEN 'symbol_only'
           WHEN regexp_full_match(t, '[+\-]\d+([.,]\d+)?') OR regexp_full_match(t, '[R(]?\d+([.,]\d+)?(x\d+)?\)?(mm|MM|pcs|PCS)?') THEN 'dims'
           WHEN length(trim(t, '.,:;()-')) < 2 THEN 'short_fragment' ELSE 'kept' END AS kind, count(*) AS n
    FROM t GROUP BY ALL
"""

STOP = ("THE", "AND", "OF", "TO", "IN", "IS", "DER", "DIE", "UND", "DE", "LA", "LE", "EL", "LOS")


def raw_token_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document, with and without stop words."""
    d = texts(spark, sf)
    return d.select("doc_id", F.size(tokens(F.col("text"))).alias("n_all"), F.size(without_stop_words(F.col("text"), list(STOP))).alias("n_kept"))


_RAW_TOKEN_STOPWORDS = rf"""
    WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS t FROM documents)
    SELECT doc_id, len(t)::INT AS n_all, len(list_filter(t, lambda x: upper(rtrim(x, ':;,.')) NOT IN ({", ".join(f"'{w}'" for w in STOP)})))::INT AS n_kept FROM t
"""

PATTERNS = {"license": r"(?i)licen[cs]e", "at_sign": r"@", "number": r"[0-9]+", "shout": r"!!"}


def pattern_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and hits of each pattern by language."""
    return stats.pattern_hits(texts(spark, sf), "text", PATTERNS, ["lang"])


_PATTERN_HITS = "SELECT lang, count(*) AS docs, " + ", ".join(
    f"count(*) FILTER (regexp_matches(text, '{p}')) AS docs_{n}, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS hits_{n}" for n, p in PATTERNS.items()
) + " FROM documents GROUP BY lang"


def symbol_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of eight classes of symbols and notes over every document with a note after it, by language."""
    d = texts(spark, sf).select("lang", F.expr(_SYMBOLS).alias("text")).select("lang", *stats.symbol_hits(F.col("text")))
    return d.groupBy("lang").agg(*[x for n in stats.SYMBOL_CLASSES for x in (F.sum((F.col(n) > 0).cast("int")).alias(f"docs_{n}"), F.sum(n).alias(f"hits_{n}"))])


_SYMBOLS = "concat(coalesce(text, ''), ' iso 2553 Ra ', doc_id % 9, ' Sa 2½ ISO-2768-m ⌖ Datum A, ral 7035 RAL ', 7000 + doc_id % 9, ' S355 s355 Galvanized 1.4301 Ø12 D50, dia ', doc_id, ' Karheus Materiaali: x')"


def _symbol_sql(name: str) -> str:
    # RE2 looks at nothing ahead: what follows is taken into the match, which no other match begins in
    flag = "" if name in stats.MIND_CASE else "(?i)"
    return " + ".join("len(regexp_extract_all(t, '" + flag + p.replace("(?=[\\s,\\-\\.])", "[\\s,\\-\\.]") + "'))" for p in stats.SYMBOL_CLASSES[name])


_SYMBOL_CLASSES = (
    f"WITH d AS (SELECT lang, {_SYMBOLS} AS t FROM documents), h AS (SELECT lang, " + ", ".join(f"{_symbol_sql(n)} AS {n}" for n in stats.SYMBOL_CLASSES) + " FROM d) SELECT lang, "
    + ", ".join(f"count(*) FILTER ({n} > 0) AS docs_{n}, sum({n})::BIGINT AS hits_{n}" for n in stats.SYMBOL_CLASSES) + " FROM h GROUP BY lang"
)


def long_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of documents without the short ones, and texts long enough to train on."""
    from plansift.operators.documents import without_short

    d = texts(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("block"))
    kept = without_short(d, "block").groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum((F.char_length(F.trim("block")) >= 15).cast("int")).alias("trained"))
    return kept.select("doc_id", "blocks", "trained")


_LONG_BLOCKS = "SELECT doc_id, count(*) AS blocks, sum((length(trim(b)) >= 15)::INT) AS trained FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM documents) WHERE length(trim(b)) >= 3 GROUP BY 1"


def common_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that were returned, accepted and neither, and shipped by the first suppliers: a chained intersect."""
    l = table(spark, sf, "lineitem")
    return stats.common_keys([l.filter(F.col("l_returnflag") == f) for f in ("R", "A", "N")] + [l.filter("l_suppkey <= 60")], "l_partkey")


_COMMON_STEMS = "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey <= 60"


def head_noun_type(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by the first part-type word of their name."""
    return table(spark, sf, "part").select(part_type(F.col("p_name")).alias("part_type")).groupBy("part_type").agg(F.count(F.lit(1)).alias("n"))


_HEAD_NOUN_TYPE = f"""
    SELECT nullif(lower(regexp_extract(p_name, '(?i)\\b({'|'.join(PART_TYPES)})s?\\b', 1)), '') AS part_type, count(*) AS n
    FROM part GROUP BY 1
"""


def log_size_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the power of two of their size."""
    return texts(spark, sf).groupBy(stats.log_bucket(F.col("n_chars")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_LOG_SIZE_BUCKETS = "SELECT floor(log2(greatest(n_chars, 1)))::INT AS bucket, count(*) AS n FROM documents GROUP BY 1"


def length_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of size with words, and words by quartile of size."""
    d = texts(spark, sf).select("n_chars", F.size(tokens(F.col("text"))).alias("words"))
    cuts = d.agg(F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    at = F.size(F.filter("q", lambda q: F.col("n_chars") > q))
    marked = d.crossJoin(F.broadcast(cuts)).withColumn("quartile", at)
    whole = d.agg(F.round(F.corr("n_chars", "words"), 6).alias("correlation"))
    return marked.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("words"), 6).alias("mean_words")).crossJoin(F.broadcast(whole))


_LENGTH_CORRELATION = r"""
    WITH d AS (SELECT n_chars, len(list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) AS w FROM documents),
         q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c, round(corr(n_chars, w), 6) AS correlation FROM d)
    SELECT ((n_chars > a)::INT + (n_chars > b)::INT + (n_chars > c)::INT) AS quartile, count(*) AS n, round(avg(w), 6) AS mean_words, any_value(correlation) AS correlation FROM d, q GROUP BY 1
"""


def incremental_done_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that nobody has labelled yet."""
    from plansift.streaming.incremental import pending

    return pending(texts(spark, sf).select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


_INCREMENTAL_DONE_ANTIJOIN = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def indicator_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A 0/1 column for each label of each labelled document."""
    from plansift.operators.models import indicator

    lab = table(spark, sf, "labels")
    long = lab.select("doc_id", F.explode(F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.lit("any")), lambda x: x.isNotNull())).alias("label"))
    return indicator(long, "doc_id", "label", ["quality", "toxic"])


_INDICATOR_PIVOT = "SELECT doc_id, max((quality = 1)::INT) AS is_quality, max((toxic = 1)::INT) AS is_toxic FROM labels GROUP BY doc_id"


def word_count_route(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by route: few words go to recognition."""
    d = texts(spark, sf).withColumn("route", F.when(F.size(tokens(F.col("text"))) <= 50, "ocr").otherwise("vector"))
    return d.groupBy("lang", "route").agg(F.count(F.lit(1)).alias("n"))


_WORD_COUNT_ROUTE = r"""
    SELECT lang, CASE WHEN len(list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) <= 50 THEN 'ocr' ELSE 'vector' END AS route, count(*) AS n FROM documents GROUP BY ALL
"""


def duplicate_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each text."""
    return texts(spark, sf).groupBy(F.xxhash64("text").alias("__h"), F.sha2("text", 256).alias("__s")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_DUPLICATE_FIRST = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"


def best_run_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The source with the greatest mean size of each language."""
    m = texts(spark, sf).groupBy("lang", "source").agg(F.avg("n_chars").alias("score"))
    return stats.best_per_group(m, "lang", "score", "source").select("lang", "source", F.round("score", 6).alias("score"))


_BEST_RUN_PER_GROUP = """
    WITH m AS (SELECT lang, source, avg(n_chars) AS score FROM documents GROUP BY ALL)
    SELECT lang, source, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, source) = 1
"""


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day and type; an extra beyond drawings."""
    from plansift.streaming.windows import tumbling

    return tumbling(table(spark, sf, "events"), "1 day").select(F.col("start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_EVENTS_TUMBLING = "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users that end after six hours without events; an extra beyond drawings."""
    from plansift.streaming.windows import sessions

    return sessions(table(spark, sf, "events"), "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


_EVENTS_SESSIONS = """
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
         s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e),
         n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
    SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id
"""

PAIRS = [
    (symbol_classes, _SYMBOL_CLASSES), (long_blocks, _LONG_BLOCKS), (common_stems, _COMMON_STEMS),
    (linkage_heads, _LINKAGE_HEADS), (linkage_fallback, _LINKAGE_FALLBACK), (bom_components, _BOM_COMPONENTS), (prod_line_labels, _PROD_LINE_LABELS), (family_of_order, _FAMILY_OF_ORDER),
    (item_buckets, _ITEM_BUCKETS), (pdf_buckets, _PDF_BUCKETS), (top_level_parents, _TOP_LEVEL_PARENTS), (singleton_share, _SINGLETON_SHARE), (histogram_components, _HISTOGRAM_COMPONENTS),
    (quartiles_words, _QUARTILES_WORDS), (composition_by_source, _COMPOSITION_BY_SOURCE), (work_content, _WORK_CONTENT), (offby_k, _OFFBY_K), (set_overlap_metrics, _SET_OVERLAP_METRICS),
    (group_metrics, _GROUP_METRICS), (bom_nonunique_micro, _BOM_NONUNIQUE_MICRO), (vote_components, _VOTE_COMPONENTS), (component_coverage, _COMPONENT_COVERAGE), (line_df_filter, _LINE_DF_FILTER),
    (crosspage_dedup, _CROSSPAGE_DEDUP), (undouble_names, _UNDOUBLE_NAMES), (light_clean_counts, _LIGHT_CLEAN_COUNTS), (raw_token_stopwords, _RAW_TOKEN_STOPWORDS), (pattern_hits, _PATTERN_HITS),
    (head_noun_type, _HEAD_NOUN_TYPE), (log_size_buckets, _LOG_SIZE_BUCKETS), (length_correlation, _LENGTH_CORRELATION), (incremental_done_antijoin, _INCREMENTAL_DONE_ANTIJOIN),
    (indicator_pivot, _INDICATOR_PIVOT), (word_count_route, _WORD_COUNT_ROUTE), (duplicate_first, _DUPLICATE_FIRST), (best_run_per_group, _BEST_RUN_PER_GROUP), (events_tumbling, _EVENTS_TUMBLING), (events_sessions, _EVENTS_SESSIONS),
]
