"""Non-negative matrix factors of TF-IDF rows, and how topics move over the years."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import word_list
from ..storage import stage
from .trends import forecast


def tf_idf_rows(docs: DataFrame, doc: str, text: str, vocabulary: int = 1400, min_df: int = 2, max_share: float = 0.82, stop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``doc, i, x``: each document's terms (places in the vocabulary) and their TF-IDF of length 1, staged; and the vocabulary.

    The vocabulary is the ``vocabulary`` terms of highest corpus frequency among those in ``min_df`` documents or more
    and in at most ``max_share`` of all. Documents without such a term have no row.
    """
    words = F.filter(word_list(F.col(text)), lambda w: (F.length(w) >= 2) & ~w.isin(*stop)) if stop else F.filter(word_list(F.col(text)), lambda w: F.length(w) >= 2)
    listed = docs.select(F.col(doc).alias("doc"), words.alias("w"))
    n = docs.count()
    term = lambda w: listed.select(F.explode_outer(w).alias("term")).where("term is not null").groupBy("term")
    stats = term("w").agg(F.count("*").alias("cf")).join(term(F.array_distinct("w")).agg(F.count("*").alias("df")), "term")
    chosen = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_share * n)).orderBy(F.desc("cf"), "term").limit(vocabulary).collect()
    names = [r.term for r in chosen]
    spark = docs.sparkSession
    table = spark.createDataFrame([(r.term, i, float(np.log((1 + n) / (1 + r.df)) + 1)) for i, r in enumerate(chosen)], "term string, i int, idf double")
    hits = listed.select("doc", F.explode_outer("w").alias("term")).join(F.broadcast(table), "term")  # at most ``vocabulary`` rows
    weights = hits.groupBy("doc", "i").agg((F.count("*") * F.first("idf")).alias("x"))
    rows = weights.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("f"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return stage(rows.select("doc", F.col("f.i").alias("i"), F.transform("f.x", lambda x: x / F.col("norm")).alias("x")), "tf-idf"), names


def _weights(xh: np.ndarray, hh: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative rows w that come nearest to given products with h: coordinate descent, a column at a time."""
    w = np.maximum(xh / np.maximum(hh.diagonal(), 1e-12), 0) / len(hh)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(hh)):
            if hh[j, j] > 0:
                new = np.maximum(w[:, j] + (xh[:, j] - w @ hh[:, j]) / hh[j, j], 0)
                moved = max(moved, float(np.abs(new - w[:, j]).max(initial=0)))
                w[:, j] = new
        if moved < 1e-8:
            break
    return w


def _products(batch: pa.RecordBatch, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of rows: where each one's terms begin, terms, values, and x times h transposed."""
    first = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    i, x = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
    return first, i, x, np.add.reduceat(x[:, None] * h.T[i], first[:-1]) if len(x) else np.zeros((0, len(h)))


def _sums(shared, sweeps: int):
    """Rows -> one row of sums: w'x (flat), w'w (flat), the squares of x, and the loss."""

    def run(batches):
        h = shared.value
        hh = h @ h.T
        up, down, square, loss = np.zeros_like(h), np.zeros_like(hh), 0.0, 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                first, i, x, xh = _products(batch.slice(at, 4096), h)
                w = _weights(xh, hh, sweeps)
                row = np.repeat(np.arange(len(w)), np.diff(first))
                for j in range(len(h)):
                    up[j] += np.bincount(i, w[row, j] * x, minlength=h.shape[1])
                down += w.T @ w
                square += float(x @ x)
                loss += float(x @ x - 2 * (w * xh).sum() + ((w @ hh) * w).sum())
        flat = np.concatenate([up.ravel(), down.ravel(), [square, loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "v"])

    return run


@dataclass
class Factors:
    """Topics over a vocabulary, the rows they were fitted to, and the loss after each round."""

    rows: DataFrame
    names: list[str]
    h: np.ndarray
    losses: list[float]
    sweeps: int = 200

    @staticmethod
    def fit(rows: DataFrame, names: list[str], k: int, most_rounds: int = 220, tolerance: float = 1e-4, sweeps: int = 200, seed: int = 42) -> Factors:
        """Alternate between the documents' weights, solved in their tasks, and the topics, solved from sums over all documents.

        The loss falls in every round; it ends when it falls by less than ``tolerance`` of the first loss, or after
        ``most_rounds``. The driver has the topics (k by the vocabulary) and sums of that size alone.
        """
        spark = rows.sparkSession
        h = np.random.default_rng(seed).random((k, len(names))) / np.sqrt(max(len(names), 1))
        losses: list[float] = []
        for _ in range(most_rounds if names else 0):
            shared = spark.sparkContext.broadcast(h)
            total = rows.mapInArrow(_sums(shared, sweeps), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
            shared.unpersist()
            flat = np.zeros(h.size + k * k + 2)
            flat[total["at"].to_numpy()] = total["v"].to_numpy()
            up, down = flat[: h.size].reshape(h.shape), flat[h.size : h.size + k * k].reshape(k, k)
            losses.append(float(flat[-1]))
            if len(losses) > 1 and losses[-2] - losses[-1] < tolerance * losses[0]:
                break
            for _ in range(sweeps):
                before = h.copy()
                for j in range(k):
                    if down[j, j] > 0:
                        h[j] = np.maximum(h[j] + (up[j] - down[j] @ h) / down[j, j], 0)
                if np.abs(h - before).max() < 1e-10:
                    break
        return Factors(rows, names, h, losses, sweeps)

    def words(self, most: int = 12) -> DataFrame:
        """``topic, rank, term``: the terms of greatest weight of each topic."""
        best = [(t, r, self.names[i]) for t in range(len(self.h)) for r, i in enumerate(np.argsort(-self.h[t], kind="stable")[:most].tolist())] if self.names else []
        return self.rows.sparkSession.createDataFrame(best, "topic int, rank int, term string")

    def topics(self) -> DataFrame:
        """``doc, topic, weight``: each document's topic of greatest weight."""
        shared, sweeps = self.rows.sparkSession.sparkContext.broadcast(self.h), self.sweeps

        def run(batches):
            h = shared.value
            hh = h @ h.T
            for batch in batches:
                w = _weights(_products(batch, h)[3], hh, sweeps)
                best = w.argmax(1) if len(w) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(np.round(w[np.arange(len(w)), best], 6))], names=["doc", "topic", "weight"])

        return self.rows.mapInArrow(run, f"doc {self.rows.schema['doc'].dataType.simpleString()}, topic int, weight double")


def topic_trends(shares: DataFrame, words: DataFrame, years: list[int], topic: str = "topic", year: str = "year", papers: str = "papers") -> DataFrame:
    """A row for each topic: its papers in each of ``years`` (columns ``y<year>``, 0 where none), the forecast for the year after, and its words.

    ``shares`` has ``topic, year, papers``; ``words`` has ``topic`` and any columns. The last of the years, which may be incomplete, is not fitted
    unless it is the only one.
    """
    wide = shares.groupBy(topic).pivot(year, years).agg(F.sum(papers)).na.fill(0)
    wide = wide.select(topic, *[F.col(f"`{y}`").cast("long").alias(f"y{y}") for y in years])
    point: Column = F.explode(F.array(*[F.struct(F.lit(y).alias(year), F.col(f"y{y}").cast("double").alias("value")) for y in years]))
    grid = wide.select(topic, point.alias("p")).select(topic, f"p.{year}", "p.value")
    fit = years[-2] if len(years) > 1 else years[-1]
    next_year = forecast(grid, fit, topic, year, "value").select(topic, F.lit(fit + 1).alias("next_year"), F.col("forecast"), F.col("slope").alias("trend_slope"))
    return wide.join(next_year, topic).join(words, topic, "left")
