"""Expansion of questions by keywords that occur together with those they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, n_grams, word_list
from ..storage import few, stage
from .filters import is_noise_keyword

#: Keywords named by questions that are broadcast after being counted; more are joined by a shuffle.
BROADCAST_SEEDS = 200_000


def named_keywords(questions: DataFrame, question: str, text: str, papers: DataFrame, keyword: str, longest: int = 3) -> DataFrame:
    """``question, keyword``: the real keywords among a question's runs of up to ``longest`` words, in any case."""
    grams = F.array_distinct(bound(word_list(F.col(text)), lambda w: n_grams(w, 1, longest)))
    asked = questions.select(F.col(question).alias("question"), F.explode(grams).alias("low"))
    known = papers.select(F.col(keyword).alias("keyword")).distinct().withColumn("low", F.lower("keyword"))
    return known.join(asked, "low").select("question", "keyword").distinct()


def neighbours(seeds: DataFrame, papers: DataFrame, paper: str, keyword: str, most: int = 8) -> DataFrame:
    """``question, keyword, n, rank``: keywords of the papers that have a question's seeds, by the number of such papers.

    A paper counts once however many seeds it has. Seeds themselves and noise keywords are left out before the ``most`` are
    taken; ties go by keyword.
    """
    pairs = papers.select(F.col(paper).alias("paper"), F.col(keyword).alias("keyword")).where("paper is not null and keyword is not null").distinct()
    sets = stage(seeds.groupBy("question").agg(F.array_sort(F.collect_set("keyword")).alias("seeds")), "seeds")
    # questions of the same seeds have the same neighbours, which are counted once
    asked = stage(sets.select("seeds").distinct().select("seeds", F.xxhash64("seeds", F.lit(0)).alias("h1"), F.xxhash64("seeds", F.lit(1)).alias("h2")), "seeds")
    key = F.struct("h1", "h2").alias("set")
    few_sets = few(asked.select(key, F.explode("seeds").alias("keyword")), BROADCAST_SEEDS)
    found = pairs.join(few_sets, "keyword").select("set", "paper").distinct()
    near = found.join(pairs.where(~is_noise_keyword(F.col("keyword"))), "paper").groupBy("set", "keyword").agg(F.count("*").alias("n"))
    own = asked.select(key, F.explode("seeds").alias("keyword")).select("set", F.lower("keyword").alias("low")).distinct()
    rest = near.withColumn("low", F.lower("keyword")).join(own, ["set", "low"], "left_anti").drop("low")
    order = Window.partitionBy("set").orderBy(F.desc("n"), "keyword")
    best = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    of = sets.join(asked.select("seeds", key), "seeds").select("question", "set")
    return of.join(best, "set").select("question", "keyword", "n", "rank")


def best_chunks(ranked: DataFrame, chunks: DataFrame, chunk: str, paper: str, pool: int = 40) -> DataFrame:
    """``query, paper, chunk, score, rank``: of ranked chunks (``query, doc, score, rank``) the first of each paper, ranked again."""
    of = chunks.select(F.col(chunk).alias("doc"), F.col(paper).alias("paper"))
    first = few(ranked).join(of, "doc").groupBy("query", "paper").agg(F.min_by(F.struct("doc", "score", "rank"), "rank").alias("b"))
    order = Window.partitionBy("query").orderBy("b.rank")
    again = first.select("query", "paper", F.col("b.doc").alias("chunk"), F.col("b.score").alias("score"), F.row_number().over(order).alias("rank"))
    return again.where(F.col("rank") <= pool)
