"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt, discard, stage


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either linked to one smaller node or to larger ones alone."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node with an edge to another; the component is its least node.

    Each round links all larger neighbours of a node to its least neighbour, then does the same
    among smaller ones, until the edges are stars: no node is linked to two smaller ones, and none
    to a smaller and a larger one. That is tested on all edges, so the result is exact. Edges are
    distinct rows throughout, minima are pre-aggregated, and every round is written to the shared
    folder, so a round costs a few joins on the edges that are left, with a lineage of one step.
    Edges with a null end and loops say nothing and are ignored; repeated edges count once; without
    edges there are no rows.
    """
    pairs = edges.select(
        F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"), (F.col(src) != F.col(dst)).alias("link")
    )
    now = stage(pairs.where("link").select("hi", "lo").distinct(), "components")
    while True:
        rows = now.count()
        both = now.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(
            now.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        )
        both = dealt(both, 2 * rows, "a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        large = dealt(large, rows, "hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(least, "hi")
        small = (
            linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where("hi != lo")
            .union(linked.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        after = stage(small, "components")
        discard(now)
        now = after
        if _stars(now):
            break
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
