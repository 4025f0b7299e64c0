"""Votes, set-overlap and ranking measures, as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal rank fusion.
RRF = 60


def vote(neighbours: DataFrame, values: DataFrame, least: int = 1, query: str = "query", candidate: str = "candidate", key: str = "id", value: str = "value") -> DataFrame:
    """``query, value, votes``: how many of a query's neighbours have a value, ``least`` or more."""
    has = values.select(F.col(key).alias(candidate), F.col(value).alias("value")).distinct()
    return (
        neighbours.select(query, candidate).join(has, candidate).groupBy(query, "value")
        .agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= least)
    )


def group_votes(members: DataFrame, values: DataFrame, group: str, least: int = 1, key: str = "query", value: str = "value") -> DataFrame:
    """``query, value, votes`` where the neighbours of a member are all others of its group.

    A value's votes are the members of the group that have it, less the member
    itself: no pair of members is formed.
    """
    has = values.select(key, F.col(value).alias("value")).distinct()
    counts = members.select(key, group).join(has, key).groupBy(group, "value").agg(F.count(F.lit(1)).alias("n"))
    due = members.select(key, group).join(counts, group).join(has.withColumn("own", F.lit(1)), [key, "value"], "left")
    return due.select(key, "value", (F.col("n") - F.coalesce("own", F.lit(0))).alias("votes")).filter(F.col("votes") >= least)


def group_vote_counts(members: DataFrame, values: DataFrame, group: str, key: str = "query", value: str = "value") -> DataFrame:
    """``n_true, n_pred, n_both`` of :func:`group_votes` with one vote, summed over the members that have a value, for each ``scope``.

    ``values`` has a ``scope`` beside key and value. A value that two or more
    members have is proposed to all of them, and one that a single member has to
    all others, so counts by group are enough and no proposal is written out.
    """
    has = values.select("scope", key, F.col(value).alias("value")).distinct().join(members.select(key, group), key)
    size = has.groupBy("scope", group).agg(F.count_distinct(key).alias("m"))
    counts = has.groupBy("scope", group, "value").agg(F.count(F.lit(1)).alias("c"))
    several = F.col("c") >= 2
    return counts.join(size, ["scope", group]).groupBy("scope").agg(
        F.sum("c").alias("n_true"), F.sum(F.when(several, F.col("m")).otherwise(F.col("m") - 1)).alias("n_pred"), F.sum(F.when(several, F.col("c")).otherwise(0)).alias("n_both")
    )


def overlap(truth: DataFrame, predicted: DataFrame, query: str = "query", value: str = "value") -> DataFrame:
    """Precision, recall, F1, Jaccard, hit, exactness and the number of differences of each query that has a truth.

    Both tables are in long form. Without a prediction precision is 0.
    """
    t = truth.select(query, value).distinct().withColumn("t", F.lit(1))
    p = predicted.select(query, value).distinct().withColumn("p", F.lit(1))
    both = t.join(p, [query, value], "full_outer").groupBy(query).agg(
        F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("n_both")
    ).filter("n_true > 0")
    either = F.col("n_true") + F.col("n_pred") - F.col("n_both")
    return both.select(
        query, "n_true", "n_pred", "n_both",
        F.coalesce(F.try_divide("n_both", "n_pred"), F.lit(0.0)).alias("precision"),
        (F.col("n_both") / F.col("n_true")).alias("recall"),
        (2 * F.col("n_both") / (F.col("n_true") + F.col("n_pred"))).alias("f1"),
        (F.col("n_both") / either).alias("jaccard"),
        (F.col("n_both") > 0).cast("int").alias("hit"),
        (either == F.col("n_both")).cast("int").alias("exact"),
        (either - F.col("n_both")).alias("off_by"),
    )


def summary() -> list[Column]:
    """Aggregates over :func:`overlap`: the four measures that go by like names, apart."""
    tp, pred, true = F.sum("n_both"), F.sum("n_pred"), F.sum("n_true")
    return [
        F.count(F.lit(1)).alias("n"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("sample_f1"),
        F.avg("jaccard").alias("mean_jaccard"), F.avg("hit").alias("hit_rate"), F.avg("exact").alias("exact_match"),
        F.coalesce(F.try_divide(tp, pred), F.lit(0.0)).alias("micro_precision"), F.coalesce(F.try_divide(tp, true), F.lit(0.0)).alias("micro_recall"),
        F.coalesce(F.try_divide(2 * tp, pred + true), F.lit(0.0)).alias("micro_f1"),
        F.avg((F.col("off_by") <= 1).cast("double")).alias("off_by_1"), F.avg((F.col("off_by") <= 2).cast("double")).alias("off_by_2"),
    ]


def label_f1(truth: DataFrame, predicted: DataFrame, query: str = "query", value: str = "value") -> DataFrame:
    """F1 of each label that has a true row; their mean is the macro F1 by label."""
    t = truth.select(query, value).distinct().withColumn("t", F.lit(1))
    p = predicted.select(query, value).distinct().join(truth.select(query).distinct(), query, "left_semi").withColumn("p", F.lit(1))
    return (
        t.join(p, [query, value], "full_outer").groupBy(value)
        .agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("n_both"))
        .filter("n_true > 0").withColumn("f1", 2 * F.col("n_both") / (F.col("n_true") + F.col("n_pred")))
    )


def ranking(runs: DataFrame, hits: DataFrame, k: int, query: str = "query", candidate: str = "candidate", rank: str = "rank") -> DataFrame:
    """Success, precision at 1, reciprocal rank, recall at k and average precision of each query with hits.

    ``runs`` ranks candidates from 1; ``hits`` lists the relevant ones.
    """
    relevant = hits.select(query, candidate).distinct().withColumn("hit", F.lit(1))
    marked = runs.filter(F.col(rank) <= k).select(query, candidate, rank).join(relevant, [query, candidate], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return marked_ranking(marked, relevant.groupBy(query).agg(F.count(F.lit(1)).alias("n_hits")), k, query, rank)


def marked_ranking(runs: DataFrame, number: DataFrame, k: int, query: str = "query", rank: str = "rank") -> DataFrame:
    """The measures of :func:`ranking` where ``runs`` has ``hit``, 0 or 1, and ``number`` a query's ``n_hits``, so that no pair is written that no run has."""
    marked = runs.filter(F.col(rank) <= k)
    so_far = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marked.withColumn("so_far", F.sum("hit").over(so_far))
    per = seen.groupBy(query).agg(
        F.max("hit").alias("success"), F.max(F.when(F.col(rank) == 1, F.col("hit")).otherwise(0)).alias("p_at_1"),
        F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / F.col(rank))), F.lit(0.0)).alias("reciprocal_rank"),
        F.sum("hit").alias("found"), F.count(F.lit(1)).alias("listed"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col(rank)).otherwise(0.0)).alias("precisions"),
    )
    return per.join(number, query).select(
        query, "success", "p_at_1", "reciprocal_rank", (F.col("found") / F.col("n_hits")).alias("recall"), (F.col("precisions") / F.least("n_hits", "listed")).alias("average_precision")
    )


def reciprocal_rank_fusion(runs: DataFrame, constant: int = RRF, query: str = "query", candidate: str = "candidate", rank: str = "rank") -> DataFrame:
    """Fused scores of several runs in one table: the sum of 1 / (constant + rank)."""
    return runs.groupBy(query, candidate).agg(F.sum(1.0 / (constant + F.col(rank))).alias("score"))


def min_max(scores: DataFrame, score: str, name: str, span_least: float = 1e-12) -> DataFrame:
    """Scores between 0 and 1 over the whole table, which holds no row of a query with itself; 0 where all are equal.

    The two limits are one row, joined to all.
    """
    limits = scores.agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    span = F.col("__high") - F.col("__low")
    return scores.crossJoin(F.broadcast(limits)).withColumn(name, F.when(span < span_least, 0.0).otherwise((F.col(score) - F.col("__low")) / span)).drop("__low", "__high")


def method_overlap(runs: DataFrame, k: int, query: str = "query", candidate: str = "candidate", rank: str = "rank", method: str = "method") -> DataFrame:
    """The mean number of candidates that two methods share among their first ``k``, for each pair of methods."""
    top = runs.filter(F.col(rank) <= k).groupBy(query, method).agg(F.collect_set(candidate).alias("own"))
    a, b = top.alias("a"), top.alias("b")
    pairs = a.join(b, (F.col(f"a.{query}") == F.col(f"b.{query}")) & (F.col(f"a.{method}") < F.col(f"b.{method}")))
    return pairs.groupBy(F.col(f"a.{method}").alias("first"), F.col(f"b.{method}").alias("second")).agg(F.avg(F.size(F.array_intersect("a.own", "b.own"))).alias("shared"))


def lift(value: Column, base: Column) -> Column:
    """A measure against its base; null where the base is 0."""
    return F.try_divide(value, base)


def random_neighbours(queries: DataFrame, index: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``k`` pseudo-random index rows of each query, never itself: the base that measures are held against.

    Index rows get a hash; each query starts at its own hash and takes the
    rows that follow, which needs ranks of the index only and no pairs.
    """
    from plansift.sources.readers import with_row_numbers

    n = index.count()
    hashed = index.select(F.col(id_col).alias("candidate")).withColumn("h", F.xxhash64(F.lit(seed), "candidate"))
    ranked = with_row_numbers(hashed, ["h", "candidate"], "at").select("candidate", (F.col("at") - 1).alias("at"))
    starts = queries.select(F.col(id_col).alias("query")).withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 1), "query"), F.lit(max(n, 1))))
    wanted = starts.select("query", "start", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("pos")).select("query", "pos", F.pmod(F.col("start") + F.col("pos"), F.lit(max(n, 1))).cast("long").alias("at"))
    met = wanted.join(ranked, "at").filter("query <> candidate")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).filter(F.col("rank") <= k).select("query", "candidate", "rank")


def majority_baseline(labelled: DataFrame, label: str = "value") -> DataFrame:
    """The most frequent label, the least of several, and how often always saying it is right."""
    n = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n").alias("most"), F.sum("n").alias("all"))  # one row
    return n.join(F.broadcast(top), F.col("n") == F.col("most")).groupBy("most", "all").agg(F.min(label).alias(label)).select(label, (F.col("most") / F.col("all")).alias("accuracy"))
