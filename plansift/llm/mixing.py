"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: a share of ``share`` times all
words by its weight, stopped at ``cap`` times what the source has, the excess
going to the sources that are below their stop, by weight, until none is above.
A document of a source then has the fractional number of copies
``target / source_size``. Its whole part is taken at once; the fractional
parts are rounded by the pivotal method: two documents meet, mass moves
between them at random, keeping the words expected from the two, until one of
them is 0 or 1, and the other goes on to the next meeting. What is left of a
group of documents after all its meetings is one document; these meet again
on the next level, a tree of groups of bounded size, until each source has one.

So a source's words differ from its target by less than one document, each
document's expected copies are exactly its fraction, and no task sees more
than ``GROUP`` documents of a source at once whatever the source's size.

Defined cases: null text counts as size 0; documents of size 0 are taken 0
times; the null source is a source of its own, after the others; rows that
repeat an id are documents of their own, and rows alike in id, source and size
are numbered, so that they are dealt to groups like any other; an empty table
gives no rows. Extra columns are never read. Draws come from hashes of seed,
level, ids and those numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.llm.license_scan import word_count
from plansift.llm.rows import unused
from plansift.session import settle

#: What parts words, in Java's regular expressions.
GAP = r"[\x20\x09-\x0D]+"
#: Documents, or residuals of groups, that meet in one group.
GROUP = 64
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SEED = 20240229
#: Sources up to this number are sent to all tasks; beyond it they are joined.
FEW = 10_000


def size_of(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(word_count(text.cast("string"), GAP), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size`` (one row each) with ``weight`` and ``target``.

    The stops are found without a loop: sources leave the sharing in order of
    ``source_size / weight``, so the level of water is that of the first prefix
    in this order that holds. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_stop = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("source_size") * F.lit(cap)
    level = (
        ranked.withColumn("__all", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("__rank", F.row_number().over(by_stop))
        .withColumn("__left", F.greatest(F.col("__all") - F.coalesce(F.sum(stop).over(before), F.lit(0.0)), F.lit(0.0)))
        .withColumn("__weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / F.col("__weight"))
        # the first source in this order that is not above its stop has the level of all after it
        .withColumn("__holds", F.col("__level") * F.col("weight") <= stop)
        .withColumn("__water", F.min(F.when(F.col("__holds"), F.struct("__rank", "__level"))).over(every)["__level"])
    )
    water = F.col("__water") * F.col("weight")
    return level.select(
        "source", "source_size", "weight", F.when(F.col("__water").isNull() | (water > stop), stop).otherwise(water).cast("double").alias("target")
    )


def _uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.pmod(h, F.lit(1 << 40)).cast("double") + 0.5) / F.lit(float(1 << 40))


ITEM = "struct<draw:bigint,doc_id:bigint,size:bigint,whole:bigint,p:double>"


def _meet(items: Column, level: int, seed: int) -> Column:
    """Let the items of an array meet one after the other.

    The state is ``(held, done)``: the item that is still open and those that
    are decided. With sizes a and b and fractions p and q, moving x words from
    one to the other keeps ``a p + b q``: the first may gain
    ``min(a (1 - p), b q)`` or lose ``min(a p, b (1 - q))`` words, and gains
    with the chance that keeps both expectations.
    """

    def moved(item: Column, p: Column) -> Column:
        return F.struct(item["draw"].alias("draw"), item["doc_id"].alias("doc_id"), item["size"].alias("size"), item["whole"].alias("whole"), p.alias("p"))

    def step(state: Column, item: Column) -> Column:
        h = state["held"]
        a, p, b, q = h["size"], h["p"], item["size"], item["p"]
        up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
        gains = _uniform(seed, level, h["draw"], item["draw"]) * (up + down) < down
        # which of the two becomes integral, and its value, without trusting rounding
        first_ends = F.when(gains, a * (1 - p) <= b * q).otherwise(a * p <= b * (1 - q))
        p_new = F.when(first_ends, F.when(gains, 1.0).otherwise(0.0)).otherwise(F.when(gains, p + up / a).otherwise(p - down / a))
        q_new = F.when(first_ends, F.when(gains, q - up / b).otherwise(q + down / b)).otherwise(F.when(gains, 0.0).otherwise(1.0))
        q_new, p_new = F.least(F.greatest(q_new, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(p_new, F.lit(0.0)), F.lit(1.0))
        one, two = moved(h, p_new), moved(item, q_new)
        return F.struct(
            F.when(first_ends, two).otherwise(one).alias("held"),
            F.concat(state["done"], F.array(F.when(first_ends, one).otherwise(two))).alias("done"),
        )

    start = F.struct(F.element_at(items, 1).cast(ITEM).alias("held"), F.expr(f"cast(array() as array<{ITEM}>)").alias("done"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, step)


def dependent_rounding(items: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """Round ``source, doc_id, size, whole, p, nth`` (0 < p < 1, size > 0) to ``copies``.

    ``nth`` tells rows apart that are alike in the rest.

    Each level deals the open items of a source to groups of ``group`` by hash,
    lets them meet there and passes one item per group up. The number of
    levels follows from the largest source: ``log(n) / log(group)`` plus one.
    """
    at = items.withColumn("draw", F.xxhash64(F.lit(seed), "source", "doc_id", "size", "nth")).drop("nth")
    done: DataFrame | None = None
    level = 0
    while True:
        counts = at.groupBy(F.col("source").alias("__source")).agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0]
        if most is None:
            break
        if most == 1:
            last = at.withColumn("copies", F.col("whole") + (_uniform(seed, -1, F.col("draw")) < F.col("p")).cast("long"))
            last = last.select("source", "doc_id", "size", "copies")
            done = last if done is None else done.unionByName(last)
            break
        if most > group:
            few = F.broadcast(counts) if counts.count() <= FEW else counts
            dealt = at.join(few, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
                "cell", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "draw"), F.ceil(F.col("n") / F.lit(group / 2)))
            )
        else:
            dealt = at.withColumn("cell", F.lit(0).cast("long"))
        met = settle(
            dealt.groupBy("source", "cell")
            .agg(F.sort_array(F.collect_list(F.struct("draw", "doc_id", "size", "whole", "p"))).alias("items"))
            .select("source", _meet(F.col("items"), level, seed).alias("met")),
            f"met-{level}",
        )
        ended = met.select("source", F.inline("met.done")).select(
            "source", "doc_id", "size", (F.col("whole") + F.col("p").cast("long")).alias("copies")
        )
        done = ended if done is None else done.unionByName(ended)
        rest = met.select("source", "met.held.*")
        whole = (F.col("p") <= 0) | (F.col("p") >= 1)
        done = done.unionByName(rest.filter(whole).select("source", "doc_id", "size", (F.col("whole") + F.col("p").cast("long")).alias("copies")))
        at = rest.filter(~whole)
        level += 1
    if done is None:
        done = at.select("source", "doc_id", "size", F.col("whole").alias("copies"))
    return done


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``."""
    sized = settle(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))
        .groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")),
        "sizes",
    )
    targets = settle(source_targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap), "targets")
    targets = targets.withColumnRenamed("source", "__source")
    few = F.broadcast(targets) if targets.count() <= FEW else targets
    own = F.col("source").eqNullSafe(F.col("__source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate") + F.lit(1e-12))
    rated = (
        sized.join(few, own)
        .select("source", "doc_id", "size", rate.alias("rate"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
        .select("source", "doc_id", "size", "nth", F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("long").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"))
    )
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-9)
    copies = rated.filter(~open_).select("source", "doc_id", "size", F.col("whole").alias("copies")).unionByName(dependent_rounding(rated.filter(open_), seed))
    return copies.join(few, own).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


#: Parts that the rows of one key are dealt to while they are ranked.
SALTS = 64


def _ranges(counted: DataFrame, keys: list[str], order: str, salts: int = SALTS) -> DataFrame:
    """Add ``low`` and ``high``: the range of places that each row's ``n`` takes among the rows of its keys.

    Places are dealt within salted parts of a key and over the sums of the
    parts before, so no task ranks all rows of a hot key.
    """
    salted = counted.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    part = Window.partitionBy(*keys, "salt").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = salted.groupBy(*keys, "salt").agg(F.sum("n").alias("all_")).withColumn(
        "before", F.sum("all_").over(Window.partitionBy(*keys).orderBy("salt")) - F.col("all_")
    )
    same = F.lit(True)
    named = parts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("salt").alias("salt_"), "before")
    for k in [*keys, "salt"]:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    ranked = salted.withColumn("own", F.sum("n").over(part)).join(named, same)
    return ranked.withColumn("high", F.col("own") + F.col("before")).withColumn("low", F.col("high") - F.col("n")).select(*counted.columns, "low", "high")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as its copies say.

    Rows alike in id, source and size share what the mix takes of them: each
    takes the copies of its place among them, and rows alike in all columns
    are one row with their copies summed. So the number of rows is the number
    of copies in the mix, and no list of alike rows is ever gathered.
    """
    mixed = settle(mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **params), "mix")
    id_, source, size, own, copy, print_, i, s, z = unused(docs, "__id", "__source", "__size", "__own", "__copy", "__print", "__i", "__s", "__z")
    counted = settle(mixed.groupBy(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "copies").agg(F.count(F.lit(1)).alias("n")), "counted")
    of = counted.groupBy(F.col("i").alias(i), F.col("s").alias(s), F.col("z").alias(z)).agg(F.sum("n").alias("rows"), F.sum("copies").alias(own))
    keyed = docs.withColumns({id_: F.col(id_col).cast("long"), source: F.col(source_col).cast("string"), size: size_of(F.col(text_col))})

    def same(one: tuple[str, ...], two: tuple[str, ...]) -> Column:
        return F.col(one[0]).eqNullSafe(F.col(two[0])) & F.col(one[1]).eqNullSafe(F.col(two[1])) & (F.col(one[2]) == F.col(two[2]))

    keys, far, plain = (id_, source, size), (i, s, z), ("i", "s", "z")
    single = keyed.join(of.filter((F.col("rows") == 1) & (F.col(own) > 0)).drop("rows"), same(keys, far)).drop(*far)
    several = settle(of.filter("rows > 1").select(*far), "several")
    both = single
    if not several.isEmpty():
        alike = keyed.join(several, same(keys, far), "left_semi").withColumn(print_, F.xxhash64(*docs.columns))
        # one row of each kind with the range of places its copies of itself take
        kinds = alike.groupBy(*[F.col(k).alias(p) for k, p in zip(keys, plain, strict=True)], F.col(print_).alias("print")).agg(F.count(F.lit(1)).alias("n"))
        kinds = _ranges(kinds, list(plain), "print")
        taken = _ranges(counted.join(several, same(plain, far), "left_semi"), list(plain), "copies", 1)
        taken = taken.select(*[F.col(p).alias(f) for p, f in zip(plain, far, strict=True)], "copies", F.col("low").alias("from"), F.col("high").alias("to"))
        common = F.least("high", "to") - F.greatest("low", "from")
        met = kinds.join(taken, same(plain, far) & (F.col("low") < F.col("to")) & (F.col("from") < F.col("high")))
        due = met.groupBy(*plain, "print").agg(F.sum(common * F.col("copies")).alias(own)).filter(F.col(own) > 0)
        first = alike.groupBy(*keys, print_).agg(F.first(F.struct(*docs.columns)).alias(copy))
        shared = first.join(due, same(keys, plain) & (F.col(print_) == F.col("print"))).select(f"{copy}.*", *keys, own)
        both = single.unionByName(shared)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own)))).drop(id_, source, size, own, copy)
