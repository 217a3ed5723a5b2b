"""Conversations kept within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compacted(turns: DataFrame, session: str, turn: str, text: str, budget: int, long: int, recent: int = 2, last: int = 4) -> DataFrame:
    """``session, turn, text, folded`` with old turns shortened and, in sessions over budget, the middle folded.

    Texts of more than ``long`` characters are cut to that, but for the ``recent`` last turns. In a session whose
    texts had more than ``budget`` characters together, the first turn and the ``last`` ones stay, and those between
    become one row at the place of their first, with the texts joined by line breaks; ``folded`` counts them (0 for a
    turn that stays).
    """
    own = Window.partitionBy(session)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    placed = turns.select(
        session, turn, F.coalesce(F.col(text), F.lit("")).alias("__t"), F.sum(size).over(own).alias("__all"),
        F.row_number().over(own.orderBy(F.desc(turn))).alias("__back"), F.row_number().over(own.orderBy(turn)).alias("__first"),
    )
    short = F.when((F.col("__back") > recent) & (F.length("__t") > long), F.substring("__t", 1, long)).otherwise(F.col("__t"))
    middle = (F.col("__all") > budget) & (F.col("__first") > 1) & (F.col("__back") > last)
    rows = placed.select(session, turn, short.alias("__t"), middle.alias("__middle"))
    kept = rows.where("not __middle").select(session, turn, F.col("__t").alias("text"), F.lit(0).cast("long").alias("folded"))
    listed = F.array_sort(F.collect_list(F.struct(turn, "__t")))
    folded = rows.where("__middle").groupBy(session).agg(F.min(turn).alias(turn), F.array_join(F.transform(listed, lambda x: x["__t"]), "\n").alias("text"), F.count("*").alias("folded"))
    return kept.union(folded)
