"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to lengths before dividing, as the published method does.
EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    """The dot product, summed in doubles; for many pairs see :mod:`plansift.operators.retrieval`."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, epsilon: float = EPSILON) -> Column:
    """The vector divided by its length plus epsilon."""
    return F.transform(a, lambda x: x.cast("double") / (length(a) + epsilon))


def mean_pool(views: DataFrame, group: str, vector: str, normalise: bool = True) -> DataFrame:
    """``group, vector``: the mean of each group's vectors, of length 1 if asked.

    The sum of vectors is combined before the shuffle: one row per group and
    task travels, whatever the number of views.
    """
    mean = views.filter(F.col(vector).isNotNull()).groupBy(group).agg(Summarizer.mean(array_to_vector(F.col(vector))).alias("__m"))
    out = mean.select(group, vector_to_array("__m").alias(vector))
    return out.select(group, unit(F.col(vector)).alias(vector)) if normalise else out


def top_views(views: DataFrame, group: str, area: str, key: str, n: int) -> DataFrame:
    """The ``n`` views of greatest area of each group; equal areas in order of the key."""
    order = Window.partitionBy(group).orderBy(F.col(area).desc(), F.col(key))
    return views.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).drop("__rank")


def rectangle_overlap(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """The area that two boxes given by the names of x0, y0, x1, y1 share."""
    w = F.greatest(F.least(F.col(a[2]), F.col(b[2])) - F.greatest(F.col(a[0]), F.col(b[0])), F.lit(0.0))
    h = F.greatest(F.least(F.col(a[3]), F.col(b[3])) - F.greatest(F.col(a[1]), F.col(b[1])), F.lit(0.0))
    return w * h


def box_iou(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Intersection over union of two boxes; 0 where both are empty."""
    def area(x: tuple[str, ...]) -> Column:
        return (F.col(x[2]) - F.col(x[0])) * (F.col(x[3]) - F.col(x[1]))

    both = rectangle_overlap(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The shared part of two intervals, as a share of the shorter."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    return F.coalesce(F.try_divide(shared, F.least(a1 - a0, b1 - b0)), F.lit(0.0))
