"""Mixing sources to token targets by entropy balancing.

Every source gets a target number of tokens. Among all document rates that meet the targets, the
mix takes those nearest to one copy of each document in relative entropy. Their form is an
exponential tilt: rate = exp(lambda * size / mean size), cut at the most copies allowed. The convex
dual has one multiplier for each source, and Newton steps, kept inside a shrinking bracket, solve
all of them at once on the counts of (source, size), which every row enters and which are far
fewer than rows.

Rates become whole copies cell by cell, a cell being one source and size, from large sizes to
small ones: each cell takes the copies that bring the running total nearest to the running target,
so a source misses its target only by what its small documents, at 0 to 3 copies, can't make up
(a few per cent for a source of ten documents). Within a cell, hash order of the ids and texts says which
documents get the extra copy, so reruns agree. A source's cells, one for each size that occurs in it, are
rounded together.

Null text has size 0; a null source is a source of its own, ordered last. An empty table gives an
empty mix. Repeated rows, repeated ids and null ids are documents of their own, each with its own copies.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stage
from .common import fresh_name, n_words

MOST = 3
TOLERANCE = 1e-9
ROUNDS = 200


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from one row (``source, source_size``) for each source.

    Weights go to sources in code-point order, null last, again and again. No target passes ``most``
    times its source's size; what is cut off is shared by weight among the others until none passes.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    table = stage(sizes.withColumn("weight", weight), "sources")
    total = table.agg(F.sum("source_size").alias("t")).first().t or 0
    left, level, full = float(total) * share, None, F.lit(False)
    while True:
        open_ = table.where(~full).agg(F.sum("weight").alias("w")).first().w
        if not open_:
            break
        capped = table.where(full).agg(F.sum("source_size").alias("s")).first().s or 0
        level = (left - most * capped) / open_
        over = (F.col("weight") * level > most * F.col("source_size")) | full
        if table.where(over & ~full).limit(1).count() == 0:
            break
        full = over
    goal = F.when(full, most * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.lit(level or 0.0))
    return table.select("source", "source_size", goal.alias("target"))


def _rate(most: float) -> Column:
    return F.when(F.col("saturated"), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0))))
    )


def solve_rates(cells: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """``cells`` (``source, size, n``) with the ``rate`` at which each source meets its target.

    Raises RuntimeError where ``ROUNDS`` steps do not get there; each step at least halves a closed bracket.
    """
    sums = cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("total"))
    start = sums.join(goals, sums.source.eqNullSafe(goals.source)).select(
        sums.source,
        (F.greatest("total", F.lit(1)) / F.col("docs")).alias("mean"),
        "target",
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("saturated"),
        F.lit(0.0).alias("lam"),
        F.lit(-math.inf).alias("low"),
        F.lit(math.inf).alias("high"),
    )
    state = stage(start, "multipliers")
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("mean")
        w = _rate(most)
        mass = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.*", "size", "n").withColumn("x", x)
        sums = mass.groupBy("source", "mean", "target", "saturated", "lam", "low", "high").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("got"),
            F.sum(F.when(w < most, F.col("n") * F.col("size") * F.col("x") * w).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        sums = sums.withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))).withColumn(
            "high", F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        )
        newton = F.col("lam") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.try_divide(gap, F.col("slope"))))
        newton = F.coalesce(newton, F.when(gap < 0, F.col("lam") + 4).otherwise(F.col("lam") - 4))
        middle = (F.col("low") + F.col("high")) / 2
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        narrow = F.col("high") - F.col("low") <= 1e-13 * F.greatest(F.abs("lam"), F.lit(1.0))
        done = F.col("saturated") | (F.abs(gap) <= TOLERANCE * F.greatest("target", F.lit(1.0))) | narrow
        step = F.when(done, F.col("lam")).when(inside, newton).otherwise(middle)
        after = stage(sums.select("source", "mean", "target", "saturated", step.alias("lam"), "low", "high", done.alias("done")), "multipliers")
        discard(state)
        open_ = after.where("not done").limit(1).count()
        state = after.drop("done")
        if not open_:
            break
    else:
        raise RuntimeError(f"rates not found in {ROUNDS} steps")
    rated = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.*", "size", "n")
    return rated.withColumn("x", F.col("size") / F.col("mean")).select("source", "size", "n", _rate(most).alias("rate"))


def _round_cells(most: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        due, copies = 0.0, []
        for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
            due += rate * n * size
            want = round(due / size) if size else round(rate * n)
            want = min(max(want, 0), most * n)
            due -= want * size
            copies.append(want)
        return cells.assign(copies=copies)[["source", "size", "n", "copies"]]

    return run


def _planned(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """``rows`` (``row, doc_id, source, size, mark``, staged) with ``source_size, target, copies``."""
    cells = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    goals = stage(goals, "targets")
    shape = "source string, size long, n long, copies long"
    plan = solve_rates(cells, goals, most).groupBy("source").applyInPandas(_round_cells(most), shape)
    # A cell's documents are numbered in about sqrt(n) hash buckets of about sqrt(n) documents.
    plan = plan.join(goals, plan.source.eqNullSafe(goals.source)).select(
        plan.source, "size", "n", "copies", "source_size", "target", F.ceil(F.sqrt("n") / 4).alias("buckets")
    )
    plan = stage(plan, "plan")
    order = F.xxhash64("doc_id", "mark")
    placed = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")))
    placed = stage(placed.select("row", "doc_id", "mark", "p.*", F.pmod(order, F.col("buckets")).alias("bucket")), "placed")
    filled = placed.groupBy("source", "size", "n", "copies", "bucket").agg(F.count("*").alias("m"))
    up_to = Window.partitionBy("source", "size").orderBy("bucket")
    share_of = lambda c: F.floor(F.col("copies") * c / F.col("n"))
    filled = filled.withColumn("c", F.sum("m").over(up_to)).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "m", (share_of(F.col("c")) - share_of(F.col("c") - F.col("m"))).alias("quota")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(order, "doc_id", "row"))
    ranked = placed.withColumn("rank", rank)
    same = ranked.source.eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b"))
    copies = F.floor(F.col("quota") / F.col("m")) + (F.col("rank") <= F.col("quota") % F.col("m")).cast("long")
    discard(cells)
    discard(goals)
    discard(plan)
    return ranked.join(filled, same).select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def _rows(docs: DataFrame, row: Column, doc_id: str, source: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return docs.select(
        row.alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), n_words(body).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("mark"),
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    most: int = MOST,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``."""
    rows = stage(_rows(docs, F.monotonically_increasing_id(), doc_id, source, text), "sizes")
    planned = _planned(rows, weights, share, most)
    discard(rows)
    return planned.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    most: int = MOST,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it.

    Rows are numbered and staged first, so copies go to rows, whether or not ids are unique or null.
    """
    row, times, each = fresh_name(docs, "row"), fresh_name(docs, "times"), fresh_name(docs, "copy")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = stage(_rows(numbered, F.col(row), doc_id, source, text), "sizes")
    plan = _planned(rows, weights, share, most).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    discard(rows)
    out = numbered.join(plan, row).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
