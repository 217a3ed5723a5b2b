"""Places for a caller's own models: encoders, stance judges and summarisers, each loaded once by a Python worker.

A hook is given as a factory without arguments that returns the model; it is called where the rows are, and
its result kept for the worker's later batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STANCES = ("SUPPORT", "CONTRADICT", "NEUTRAL")
_loaded: dict[str, object] = {}


def model(name: str, factory: Callable[[], object]) -> object:
    """The worker's one model of that name."""
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def encoded(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list]], key: str, text: str, name: str, prefix: str = "", batch: int = 64, done: DataFrame | None = None) -> DataFrame:
    """``key, model, vector`` of every row that ``done`` (``key, model``) has not yet under this model's ``name``.

    The encoder gets at most ``batch`` texts at a time, each with ``prefix`` before it; null counts as empty.
    """
    left = rows if done is None else rows.join(done.where(F.col("model") == name).select(key), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model(name, factory)
        for frame in frames:
            texts = [prefix + t for t in frame["text"]]
            vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield pd.DataFrame({"key": frame["key"], "model": name, "vector": [[float(x) for x in v] for v in vectors]})

    given = left.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    return given.mapInPandas(run, f"key {kind}, model string, vector array<double>").withColumnRenamed("key", key)


def judged(evidence: DataFrame, factory: Callable[[], Callable[[str, list[str]], list | None]], claim: str, doc: str, text: str, name: str) -> DataFrame:
    """``claim, doc, stance`` of the evidence of each claim, a bounded list in order of ``doc``.

    Labels that are unknown or missing are NEUTRAL; where the judge fails or gives no list, stances are null.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc")
        try:
            labels = model(name, factory)(rows["claim"].iloc[0], rows["text"].tolist())
        except Exception:  # whatever a foreign model raises, similarity alone decides then
            labels = None
        if labels is None:
            return rows.assign(stance=None)[["claim", "doc", "stance"]]
        clean = [str(x).strip().upper() for x in labels]
        clean = [x if x in STANCES else "NEUTRAL" for x in clean] + ["NEUTRAL"] * len(rows)
        return rows.assign(stance=clean[: len(rows)])[["claim", "doc", "stance"]]

    given = evidence.select(F.col(claim).cast("string").alias("claim"), F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = given.schema["doc"].dataType.simpleString()
    return given.groupBy("claim").applyInPandas(run, f"claim string, doc {kind}, stance string")


def summarised(turns: DataFrame, session: str, order: str, text: str, name: str = "join", factory: Callable[[], Callable[[list[str]], str]] | None = None) -> DataFrame:
    """``session, summary`` of each session's texts in order; without a summariser they are joined by line breaks."""
    if factory is None:
        listed = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
        return turns.groupBy(session).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("summary"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values("order")["text"].tolist()
        return pd.DataFrame({"session": rows["session"].iloc[:1], "summary": [model(name, factory)(texts)]})

    given = turns.select(F.col(session).alias("session"), F.col(order).alias("order"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = given.schema["session"].dataType.simpleString()
    return given.groupBy("session").applyInPandas(run, f"session {kind}, summary string").withColumnRenamed("session", session)
