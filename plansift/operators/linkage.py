"""Record linkage of file names with item descriptions.

A file name explodes to candidate keys, a description has one or two heads, and
the two meet in an equi-join. What is left meets descriptions again by tokens
that stand anywhere within them between non-alphanumerics; this, too, is an
equi-join, of the token with runs of the description's alphanumeric parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.functions.text import let

# Least lengths of keys by use, the shape of digit ids, and suffix variants of these ids.
KEY_LENGTH, INSIDE_LENGTH = 4, 6
DIGIT_ID = r"^\d{7,}$"
SUFFIXES = ("A", "B", "C", "D", "E", "F", "-A", "-B", "-C")


def heads(description: Column) -> Column:
    """The parts before the first ``--`` and before the first ``/``, trimmed, where there are any."""
    parts = F.array(
        F.when(F.contains(description, F.lit("--")), F.substring_index(description, "--", 1)),
        F.when(F.contains(description, F.lit("/")), F.substring_index(description, "/", 1)),
    )
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda h: h.isNotNull() & (h != "")))


def _ranges(token: Column) -> Column:
    """Every contiguous range of a token's dash-parts, and the same without digits at the end of its last part."""
    parts = F.split(token, "-")
    n = F.size(parts)

    def from_(i: Column) -> Column:
        def to(j: Column) -> Column:
            last = F.element_at(parts, j)
            bare = F.regexp_replace(last, r"\d+$", "")
            whole = F.array_join(F.slice(parts, i, j - i + 1), "-")
            short = F.array_join(F.concat(F.slice(parts, i, j - i), F.array(bare)), "-")
            return F.array(whole, F.when((bare != "") & (bare != last), short))

        return F.flatten(F.transform(F.sequence(i, n), to))

    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(1), n), from_))).otherwise(F.array().cast("array<string>"))


def _long(keys: Column, least: int = KEY_LENGTH) -> Column:
    return F.filter(keys, lambda k: k.isNotNull() & (F.char_length(k) >= least))


def _separated(key: Column) -> Column:
    """A key with a dash or slash put in at each change from a digit to a letter."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(key) - 1, F.lit(1))), lambda i: key.substr(i, F.lit(2)).rlike(r"^\d\p{L}$"))
    return F.flatten(F.transform(at, lambda i: F.transform(F.array(F.lit("-"), F.lit("/")), lambda s: F.concat(key.substr(F.lit(1), i), s, key.substr(i + 1, F.char_length(key))))))


def candidate_keys(file_name: Column) -> Column:
    """The keys that a file name may be linked by.

    The stem; parts in brackets; parts between blanks, underscores and
    semicolons; ranges of their dash-parts; suffixed forms of long digit ids;
    and forms with a separator between digit and letter.
    """
    stem = F.regexp_replace(file_name, r"\.(pdf|PDF)$", "")
    parts = F.split(stem, r"[_;\s]+")
    basic = F.array_distinct(F.concat(F.array(stem), F.regexp_extract_all(stem, F.lit(r"\(([^()]+)\)"), F.lit(1)), _long(parts), _long(F.flatten(F.transform(parts, _ranges)))))

    def with_suffixes(keys: Column) -> Column:
        more = F.flatten(F.transform(F.filter(keys, lambda k: k.rlike(DIGIT_ID)), lambda k: F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(k, s))))
        return F.array_distinct(F.concat(keys, more))

    suffixed = let(basic, with_suffixes)
    return let(suffixed, lambda keys: F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, _separated)))))


def link_heads(files: DataFrame, items: DataFrame) -> DataFrame:
    """``stem, item`` of ``files (stem)`` and ``items (item, description)`` whose key equals a head."""
    keys = files.select("stem", F.explode(candidate_keys(F.col("stem"))).alias("key"))
    own = items.select("item", F.explode(heads(F.col("description"))).alias("key"))
    # exploded keys are many times what the files' size tells, so neither side may be broadcast
    return keys.join(own.hint("merge"), "key").select("stem", "item").distinct()


#: What a part of a key is made of: letters and digits of all scripts, or of ASCII.
ANY, ASCII = r"\p{L}\p{N}", "A-Za-z0-9"


def pieces(text: Column, of: str = ANY) -> Column:
    """Alphanumeric runs and the separators between them, in turn, separators kept."""
    return F.regexp_extract_all(text, F.lit(f"[{of}]+|[^{of}]+"), 0)


def inner_run(key: Column, of: str = ANY) -> Column:
    """A key without separators at its ends."""
    return F.regexp_replace(key, f"^[^{of}]+|[^{of}]+$", "")


def most_parts(keys: DataFrame, of: str = ANY) -> int:
    """The number of alphanumeric parts of the longest key."""
    return keys.agg(F.max(F.size(F.regexp_extract_all("key", F.lit(f"[{of}]+"), 0)))).first()[0] or 1


def inside_keys(text: Column, most: int, of: str = ANY) -> Column:
    """Runs of up to ``most`` alphanumeric parts with what stands between them: what a token between boundaries can equal."""
    p = pieces(text, of)

    def runs(own: Column) -> Column:
        n = F.size(own)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(own, i - 1).rlike(f"^[{of}]"))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(2 * most - 2), F.lit(2)), lambda k: i + k <= n), lambda k: F.array_join(F.slice(own, i, k + 1), ""))))

    return F.when(F.size(p) > 0, F.array_distinct(F.element_at(F.transform(F.array(p), runs), 1))).otherwise(F.array().cast("array<string>"))


def link_inside(files: DataFrame, items: DataFrame) -> DataFrame:
    """``stem, item`` where a key of six characters or more with a digit stands in the description between non-alphanumerics.

    A key meets descriptions by its inner run, without separators at its ends,
    among their runs of up to as many parts as the longest key has; the whole
    key is then looked for. Its first occurrence must be one between boundaries.
    """
    keys = files.select("stem", F.explode(F.transform(candidate_keys(F.col("stem")), F.lower)).alias("key"))
    keys = keys.filter((F.char_length("key") >= INSIDE_LENGTH) & F.col("key").rlike(r"\d")).distinct().withColumn("inner", inner_run(F.col("key")))
    own = items.select("item", F.lower("description").alias("description")).withColumn("inner", F.explode(inside_keys(F.col("description"), most_parts(keys))))
    at = F.expr("locate(key, description)")
    before = F.when(at > 1, F.col("description").substr(at - 1, F.lit(1))).otherwise("")
    after = F.col("description").substr(at + F.char_length("key"), F.lit(1))
    free = (at > 0) & ~before.rlike(r"[\p{L}\p{N}]") & ~after.rlike(r"[\p{L}\p{N}]")
    return keys.join(own.hint("merge"), "inner").filter(free).select("stem", "item").distinct()


def link(files: DataFrame, items: DataFrame) -> DataFrame:
    """``stem, item, how``: by heads, and for stems without any, by keys inside descriptions."""
    first = link_heads(files, items)
    rest = files.select("stem").distinct().join(first.hint("merge"), "stem", "left_anti")
    return first.withColumn("how", F.lit("head")).unionByName(link_inside(rest, items).withColumn("how", F.lit("inside")))


def reach(linked: DataFrame, edges: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One hop from linked items over an edge table: distinct ``stem`` and the value reached."""
    return linked.select("stem", "item").join(edges.select(F.col(key).alias("item"), F.col(value).alias(name)), "item").select("stem", name).distinct()


def family(linked: DataFrame, items: DataFrame, family_col: str) -> DataFrame:
    """One non-empty family of each stem: the least."""
    own = items.select("item", F.col(family_col).alias("family")).filter("family <> ''")
    return linked.join(own, "item").groupBy("stem").agg(F.min("family").alias("family"))


# Shapes of drawing numbers, and the least length of a second-pass key.
SHAPES = (r"[A-Z]{2,4}\d{6,}", r"D\d{4,}[-A-Z0-9]*", r"\d{6,}-DRW\d+")
SECOND_LENGTH = 5


def second_keys(file_name: Column) -> Column:
    """Keys of the second pass: parts, dash-ranges, bracketed parts and drawing-number shapes of five characters or more."""
    stem = F.regexp_replace(file_name, r"\.[^.\s]+$", "")
    parts = F.filter(F.split(stem, r"[\s_;]+"), lambda p: p != "")

    def ranges(token: Column) -> Column:
        own = F.split(token, "-")
        n = F.size(own)
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(own, i, k), "-"))))

    shaped = [F.regexp_extract_all(stem, F.lit(s), 0) for s in SHAPES]
    keys = F.concat(F.array(stem), parts, F.flatten(F.transform(parts, ranges)), F.regexp_extract_all(stem, F.lit(r"\(([^)]+)\)"), F.lit(1)), *shaped)
    return F.array_distinct(_long(keys, SECOND_LENGTH))


def stands_free(text: Column, needle: Column) -> Column:
    """Whether a needle stands in a text between characters that are not ASCII letters or digits."""
    quoted = F.concat(F.lit(r"(?:^|[^A-Za-z0-9])\Q"), needle, F.lit(r"\E(?:[^A-Za-z0-9]|$)"))
    return F.regexp_like(text, quoted)


def second_pass(files: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """``stem, key, row_no``: rows whose description holds the longest key that any description holds, the first ``most``.

    ``edges`` has ``row_no, parent_desc, component_desc``. Keys meet
    descriptions by equality of their inner runs, with as many parts as the
    longest key has, and must stand free in them; a key of equal length to the
    longest counts in the order of its text.
    """
    from pyspark.sql import Window

    keys = files.select("stem", F.explode(second_keys(F.col("stem"))).alias("key"))
    both = edges.select("row_no", F.explode(F.array("parent_desc", "component_desc")).alias("d")).filter("d is not null")
    keys = keys.withColumn("inner", inner_run(F.col("key"), ASCII))
    runs = both.select("row_no", "d", F.explode(inside_keys(F.col("d"), most_parts(keys, ASCII), ASCII)).alias("inner"))
    met = keys.join(runs.hint("merge"), "inner").filter(stands_free(F.col("d"), F.col("key"))).select("stem", "key", "row_no").distinct()
    longest = met.groupBy("stem").agg(F.min(F.struct((-F.char_length("key")).alias("n"), "key")).alias("m")).select("stem", F.col("m.key").alias("key"))
    order = Window.partitionBy("stem").orderBy("row_no")
    return met.join(longest.hint("merge"), ["stem", "key"]).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).select("stem", "key", "row_no")
