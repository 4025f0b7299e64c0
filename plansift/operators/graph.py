"""Connected components over an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.session import settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its least node.

    Alternating large-star and small-star steps: each links the neighbours of a
    node to the least of them, which leaves the components as they are and ends
    in stars after about log(n) squared rounds at most. A node's neighbours are
    only reduced to a minimum and joined back, never collected. Every round is
    written to the shared folder.
    """
    links = settle(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null"), "links"
    )
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    at = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        # large star: neighbours above a node go to the least of the node and its neighbours
        both = at.select("u", "v").unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = (
            large.join(low, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        at = settle(small, "stars")
        now = tuple(at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    least = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
