"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of a text is hashed once; the top bits of the hash name its bin
and the least hash of each bin stays. Empty bins borrow from a bin that is
filled, which each finds by its own sequence of probes; the sequence is a
permutation of all bins, so it ends. Of each bin the four low bits are kept,
packed into hexadecimal digits, and likeness corrects for the one in sixteen
bins that agree by chance.

Defined cases: null counts as the empty text; a text of fewer words than a
shingle is one shingle of all its words (of none, the empty shingle, so that
texts without words are alike); equal texts have equal fingerprints; rows that
repeat an id follow each other by their text's hash, in the order of
:func:`with_next`, however many there are; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.text import let

#: Words in a shingle.
WORDS = 5
#: 2 ** BIN_BITS bins.
BIN_BITS = 8
#: Low-order bits kept of each bin: one hexadecimal digit.
KEPT_BITS = 4
SPACES = "\x20\t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A 64-bit hash for every run of so many words, repeats included."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        return F.when(n >= words, runs).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))

    return let(F.split(F.btrim(text, F.lit(SPACES)), SPACE), of)


def bin_minima(hashes: Column, bits: int = BIN_BITS) -> Column:
    """The least hash of every bin, in the order of signed numbers.

    Each bin also gets its greatest number as a mark. Sorted, hashes of a bin
    stand together in order, so the first of each run is the bin's least, and
    it is the mark where the bin is empty.
    """
    low = 64 - bits
    marks = F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda b: F.shiftleft(b.cast("bigint"), low).bitwiseOR(F.lit((1 << low) - 1)))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, low) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), low)))

    return let(F.sort_array(F.concat(hashes, marks)), firsts)


#: Probes written out before the loop over all bins; most empty bins find one in these.
FIRST_PROBES = 6


def densified(minima: Column, bits: int = BIN_BITS) -> Column:
    """The least hashes of all bins, empty bins filled from others.

    Bin b probes ``start(b) + t step(b)`` for t = 0, 1, ...; the step is odd and
    the number of bins a power of two, so all bins come up. Probes depend on
    the bin alone: two texts that lack a bin look in the same places.
    """
    n, low = 1 << bits, F.lit((1 << (64 - bits)) - 1)

    def of(m: Column) -> Column:
        def borrowed(b: Column) -> Column:
            mixed = F.xxhash64(F.lit("probe"), b)
            start, step = mixed.bitwiseAND(F.lit(n - 1)).cast("int"), F.shiftrightunsigned(mixed, 32).bitwiseAND(F.lit(n - 1)).bitwiseOR(F.lit(1)).cast("int")

            def at(t: Column | int) -> Column:
                h = F.get(m, (start + step * t).bitwiseAND(F.lit(n - 1)))
                return F.when(h.bitwiseAND(low) != low, h)

            rest = F.aggregate(F.sequence(F.lit(FIRST_PROBES), F.lit(n - 1)), F.lit(None).cast("bigint"), lambda s, t: F.coalesce(s, at(t)))
            # what is borrowed is hashed with the bin, or two borrowers of one bin would count it twice
            return F.xxhash64(F.coalesce(*[at(t) for t in range(FIRST_PROBES)], rest), b)

        return F.transform(m, lambda h, b: F.when(h.bitwiseAND(low) != low, h).otherwise(borrowed(b)))

    return let(minima, of)


def packed(bins: Column, bits: int = BIN_BITS) -> Column:
    """The low-order bits of all bins in an array of longs, sixteen bins to each."""
    per = 64 // KEPT_BITS

    def pack(bs: Column) -> Column:
        longs = []
        for at in range(0, 1 << bits, per):
            word: Column = F.lit(0).cast("long")
            for k in range(per):
                word = word.bitwiseOR(F.shiftleft(F.get(bs, F.lit(at + k)).bitwiseAND(F.lit((1 << KEPT_BITS) - 1)), (per - 1 - k) * KEPT_BITS))
            longs.append(word)
        return F.array(*longs)

    return let(bins, pack)


def fingerprint(text: Column, words: int = WORDS, bits: int = BIN_BITS) -> Column:
    """The packed fingerprint of a text, an array of longs."""
    return packed(densified(bin_minima(shingle_hashes(F.coalesce(text, F.lit("")), words), bits), bits), bits)


def as_text(fp: Column) -> Column:
    """A fingerprint in hexadecimal digits, one to a bin."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 64 // KEPT_BITS, "0")), ""))


def likeness(a: Column, b: Column, bits: int = BIN_BITS) -> Column:
    """The estimated share of shingles that two texts have in common, 0 to 1."""
    ones = 0x1111111111111111

    def unequal(x: Column) -> Column:
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    n = 1 << bits
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << KEPT_BITS)
    return F.greatest(((F.lit(n) - differ) / F.lit(float(n)) - chance) / (1 - chance), F.lit(0.0))


#: Rows that a range of ids is meant to hold while each row looks for its next one.
RANGE_ROWS = 20_000
MOST_RANGES = 8192
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def with_next(rows: DataFrame, id_col: str, tie_col: str, ranges: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``next``: a struct of the row that follows by falling id; the first row after the last.

    Rows of one id follow each other by the hash of ``tie_col``, which must
    settle all other columns. Ids are cut into ranges at quantiles; within a
    range a window finds the next row, and the first row of each range is also
    sent to the range above it. So rows travel once, and no task holds more
    than a range. An id that fills ranges by itself is cut by the hash; of its
    rows, those that are alike are one row while they look for the next.
    """
    fields, spark = rows.columns, rows.sparkSession
    key, tie = F.coalesce(F.col(id_col), F.lit(LEAST)), F.xxhash64(tie_col)
    n = rows.agg(F.count(F.lit(1))).first()[0]
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = ranges or max(1, min(MOST_RANGES, max(-(-n // range_rows), min(shuffle, n // 100))))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = rows.agg(F.percentile_approx(key, shares, 10 * parts)).first()[0] or []
    # an id at several quantiles in a row has more rows than a range
    hot = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b}) if n > range_rows else []
    if not hot:
        return _follow(rows, fields, key, tie, _range_of(key, None, sorted({(c, GREATEST) for c in found})))
    own = F.array_contains(F.array(*[F.lit(h).cast("bigint") for h in hot]), key)
    rest = [c for c in fields if c not in (id_col, tie_col)]
    alike = rows.filter(own).groupBy(id_col, tie_col).agg(*[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("__copies"))
    cuts = {(c, GREATEST) for c in found}
    for r in alike.groupBy(key.alias("k")).agg(F.percentile_approx(tie, shares, 10 * parts).alias("at")).collect():
        cuts |= {(r["k"], LEAST), *((r["k"], h) for h in r["at"])}
    whole = rows.filter(~own).withColumn("__copies", F.lit(1).cast("long")).unionByName(alike)
    after = _follow(whole, fields, key, tie, _range_of(key, tie, sorted(cuts)), True)
    # of rows that are alike the last alone has another one after it
    after = after.withColumn("__left", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return after.select(*fields, F.when(F.col("__left") == F.col("__copies"), F.col("next")).otherwise(F.struct(*fields)).alias("next"))


def _follow(rows: DataFrame, fields: list[str], key: Column, tie: Column, range_: Column, by_tie: bool = False) -> DataFrame:
    """Add ``next``, a struct of the fields, by a window over each range and the greatest row of the one below it.

    The greatest row of each range, a few numbers, goes to the driver and back.
    Where no id is in several ranges its number is enough (``by_tie`` false):
    all rows that have it go along, and the first of them is the next one.
    """
    spark = rows.sparkSession
    ranged = rows.withColumn("__range", range_)
    place = F.struct(key.alias("k"), tie.alias("t")) if by_tie else key
    tops = sorted((r["__range"], *(r["top"] if by_tie else (r["top"], 0))) for r in ranged.groupBy("__range").agg(F.max(place).alias("top")).collect())
    guests = spark.createDataFrame([(r, k, t, tops[(i + 1) % len(tops)][0]) for i, (r, k, t) in enumerate(tops)], "__range int, __top bigint, __top_tie bigint, __above int")
    goes = (key == F.col("__top")) & (tie == F.col("__top_tie")) if by_tie else key == F.col("__top")
    none = F.lit(None).cast("int")
    hosted = (
        ranged.join(F.broadcast(guests if by_tie else guests.drop("__top_tie")), "__range", "left")
        .withColumn("__in", F.explode(F.when(goes, F.array(none, F.col("__above"))).otherwise(F.array(none))))
        .withColumns({"__guest": F.col("__in").isNotNull(), "__in": F.coalesce("__in", "__range")})
    )
    w = Window.partitionBy("__in").orderBy("__guest", key.desc(), tie.desc())
    return hosted.withColumn("next", F.lead(F.struct(*fields)).over(w)).filter("not __guest").select(*rows.columns, "next")


def _range_of(key: Column, tie: Column | None, cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts are below the key (and its tie, where ids are cut by it), by binary search."""
    if not cuts:
        return F.lit(0)
    keys, ties = (F.array(*[F.lit(c[k]).cast("bigint") for c in cuts]) for k in (0, 1))
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]

    def step(lo: Column, s: Column) -> Column:
        k = F.get(keys, lo + s - 1)
        above = key > k if tie is None else (key > k) | ((key == k) & (tie > F.get(ties, lo + s - 1)))
        return lo + F.when((lo + s <= len(cuts)) & above, s).otherwise(0)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited forms, with likenesses.

    The edited text has its last third replaced by the start of the next
    document's text. Returns ``doc_id, n_chars, edited, fingerprint,
    edited_fingerprint, near_edited, near_next``, fingerprints packed.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("fp", fingerprint(F.col("text")))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("left(next.text, cast(floor(char_length(text) / 3) as int))"))
    return (
        with_next(rows, "doc_id", "text")
        .select("doc_id", n.cast("long").alias("n_chars"), F.when(third > 0, edited).otherwise(F.col("text")).alias("edited"), "fp", F.col("next.fp").alias("next_fp"))
        .withColumn("edited_fp", fingerprint(F.col("edited")))
        .select(
            "doc_id", "n_chars", "edited", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        )
    )
