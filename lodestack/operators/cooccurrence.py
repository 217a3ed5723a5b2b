"""Pairs of things that occur in one document, and the edges they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a document that are paired in one row.
LARGE = 512

WEIGHTS = {
    "full": lambda n: F.lit(1.0),
    "pair": lambda n: 2.0 / (n * (n - 1)),
    "author": lambda n: 1.0 / (n - 1),
    "root": lambda n: 1.0 / F.sqrt(n - 1),
}


def document_pairs(items: DataFrame, doc: str, item: str, *keep: str, max_items: int | None = None) -> DataFrame:
    """Unordered pairs ``a < b`` of distinct items of each document, with its item count ``n``.

    Items are gathered once per document and paired inside the row, so the pairs need no self-join. Documents of more than
    ``LARGE`` items are cut into runs of that many; pairs of runs are dealt out to different tasks.
    ``max_items`` leaves out documents with more items, as a choice of the caller; null items count
    for nothing.
    """
    sets = item_sets(items, doc, item, *keep)
    if max_items is not None:
        sets = sets.where(F.col("n") <= max_items)
    return set_pairs(sets, doc, *keep)


def item_sets(items: DataFrame, doc: str, item: str, *keep: str) -> DataFrame:
    """``s``, the ordered distinct items of each document that has two at least, and their number ``n``."""
    sets = items.where(F.col(item).isNotNull()).groupBy(doc, *keep).agg(F.array_sort(F.collect_set(item)).alias("s"))
    return sets.withColumn("n", F.size("s")).where("n >= 2")


def set_pairs(sets: DataFrame, doc: str, *keep: str) -> DataFrame:
    """The pairs of ``document_pairs`` of ``item_sets``, which are read twice."""
    first = sets.where(F.col("n") <= LARGE).select(doc, *keep, "n", "s", F.posexplode_outer("s").alias("i", "a"))
    small = first.select(doc, *keep, "n", "a", F.explode_outer(F.slice("s", F.col("i") + 2, F.col("n"))).alias("b")).where("b is not null")
    last = F.floor((F.col("n") - 1) / LARGE).cast("int")
    run = lambda k: F.slice("s", F.col(k) * LARGE + 1, F.lit(LARGE))
    left = sets.where(F.col("n") > LARGE).select(doc, *keep, "n", "s", F.explode(F.sequence(F.lit(0), last)).alias("p"))
    both = left.select(doc, *keep, "n", "p", "s", F.explode(F.sequence("p", last)).alias("q")).select(doc, *keep, "n", "p", "q", run("p").alias("x"), run("q").alias("y"))
    each = both.repartition(doc, "p", "q").select(doc, *keep, "n", "y", F.explode("x").alias("a"))
    large = each.select(doc, *keep, "n", "a", F.explode("y").alias("b")).where("a < b")
    return small.union(large)


def weighted_edges(pairs: DataFrame, doc: str, year: str, weight: str | Column = "pair") -> DataFrame:
    """``a, b, weight, paper_count, first_year, last_year, active_years`` of document pairs."""
    w = WEIGHTS[weight](F.col("n")) if isinstance(weight, str) else weight
    return pairs.groupBy("a", "b").agg(
        F.round(F.sum(w), 6).alias("weight"), F.count("*").alias("paper_count"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.count_distinct(year).alias("active_years"),
    )


def author_edges(pairs: DataFrame, year: str, long_paper: int = 12) -> DataFrame:
    """Collaboration edges with the three weights and the count of long papers."""
    n = F.col("n")
    return pairs.groupBy("a", "b").agg(
        F.round(F.sum(WEIGHTS["full"](n)), 6).alias("full_weight"), F.round(F.sum(WEIGHTS["pair"](n)), 6).alias("pair_weight"),
        F.round(F.sum(WEIGHTS["author"](n)), 6).alias("author_weight"), F.count("*").alias("paper_count"), F.min(year).alias("first_year"),
        F.max(year).alias("last_year"), F.count_distinct(year).alias("active_years"), F.count_if(n > long_paper).alias("long_papers"),
    )


def top_edges(edges: DataFrame, n: int, weight: str = "weight") -> DataFrame:
    """The ``n`` heaviest edges, ties by ends."""
    return edges.orderBy(F.desc(weight), "a", "b").limit(n)


def within(edges: DataFrame, nodes: DataFrame, node: str, a: str = "a", b: str = "b") -> DataFrame:
    """Edges with both ends in ``nodes``."""
    keys = nodes.select(F.col(node))
    return edges.join(keys.withColumnRenamed(node, a), a, "left_semi").join(keys.withColumnRenamed(node, b), b, "left_semi").select(*edges.columns)


def symmetric(edges: DataFrame, *keep: str) -> DataFrame:
    """Both directions of every edge as ``node, other``."""
    one = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), *keep)
    return one.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), *keep))


def ego(edges: DataFrame, center, limit: int, weight: str = "weight") -> DataFrame:
    """Edges that touch ``center``, heaviest first."""
    return edges.where((F.col("a") == center) | (F.col("b") == center)).orderBy(F.desc(weight), "a", "b").limit(limit)
