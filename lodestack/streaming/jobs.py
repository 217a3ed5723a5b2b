"""Structured Streaming jobs and their batch twins."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.cooccurrence import document_pairs
from ..operators.dedupe import upsert
from ..storage import new_path


def stream(spark: SparkSession, path: str, files_per_trigger: int = 4, done: str | None = None) -> DataFrame:
    """A Parquet file or folder as a stream; the schema is the one on disk.

    ``done`` says what becomes of files that have been read: a folder to which they are moved, or ``delete``.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if done == "delete":
        reader = reader.option("cleanSource", "delete")
    elif done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return reader.option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")


def landing(spark: SparkSession, path: str, key: str, time: str, delay: str = "40 days") -> DataFrame:
    """Records of a landing zone, each key once within the watermark."""
    return stream(spark, path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drained(spark: SparkSession, rows: DataFrame, label: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """All that a stream has now, written once to the shared folder, as a table.

    In complete mode each micro-batch replaces the one before; in update mode the latest row of each of
    ``keys`` counts.
    """
    out, marks = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    writer = rows.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(out)
    elif mode == "complete":
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(rows.schema).parquet(out)
    rest = [c for c in rows.columns if c not in keys]
    written = spark.read.schema(StructType([*rows.schema, StructField("__batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(out)
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__v")).select(*keys, *[F.col(f"__v.{c}") for c in rest])


def latest(spark: SparkSession, path: str, keys: Sequence[str], version: str) -> DataFrame:
    """Last write wins by key: every micro-batch is merged into the next version of a table."""
    base = new_path(spark, "latest")
    marks = new_path(spark, "latest-checkpoint")
    schema = spark.read.parquet(path).schema
    state = {"at": None}

    def merge(batch: DataFrame, number: int) -> None:
        target = spark.read.schema(schema).parquet(state["at"]) if state["at"] else spark.createDataFrame([], schema)
        to = f"{base}/v{number}"
        upsert(target, batch, keys, version).select(*schema.names).write.mode("overwrite").parquet(to)
        state["at"] = to

    stream(spark, path).writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return spark.read.schema(schema).parquet(state["at"]) if state["at"] else spark.createDataFrame([], schema)


def signatures(items: DataFrame, doc: str = "doc_id", item: str = "keyword") -> DataFrame:
    """``doc, signature``: equal exactly when a document's set of items is."""
    return items.groupBy(doc).agg(F.sha1(F.array_join(F.array_sort(F.collect_set(item)), "␟").cast("binary")).alias("signature"))


def edge_counts(items: DataFrame, doc: str = "doc_id", item: str = "keyword") -> DataFrame:
    return document_pairs(items, doc, item).groupBy("a", "b").agg(F.count("*").alias("n"))


def updated_edges(edges: DataFrame, old: DataFrame, new: DataFrame, doc: str = "doc_id", item: str = "keyword") -> DataFrame:
    """``edges`` of the ``old`` documents brought up to ``new``: only changed documents are paired again.

    What changed or vanished is subtracted, what changed or came is added, so the result equals a full rebuild.
    """
    before, after = signatures(old, doc, item), signatures(new, doc, item)
    same = before.join(after.withColumnRenamed("signature", "now"), doc).where("signature = now").select(doc)  # by document, as both are dealt
    minus = edge_counts(old.join(same, doc, "left_anti"), doc, item).select("a", "b", (-F.col("n")).alias("n"))
    plus = edge_counts(new.join(same, doc, "left_anti"), doc, item)
    return edges.select("a", "b", "n").union(minus).union(plus).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def session_memory(turns: DataFrame, session: str, fact: str, turn: str, keep: int = 12) -> DataFrame:
    """``session, facts`` of a stream of turns: each session's last ``keep`` distinct facts, kept as state.

    Facts come in order of ``turn`` within a micro-batch; a fact that is still remembered keeps its place.
    """

    def remember(key, batches, state):
        facts = state.get[0].split("\n") if state.exists and state.get[0] else []
        for f in pd.concat(list(batches)).sort_values(["turn", "fact"])["fact"]:
            if f and f not in facts:
                facts = [*facts, f][-keep:]
        state.update(("\n".join(facts),))
        yield pd.DataFrame({"session": [key[0]], "facts": [", ".join(facts)]})

    rows = turns.select(F.col(session).cast("string").alias("session"), F.col(fact).alias("fact"), F.col(turn).alias("turn"))
    return rows.groupBy("session").applyInPandasWithState(remember, "session string, facts string", "facts string", "update", "NoTimeout")


def pending(records: DataFrame, attempts: DataFrame, key: str, budget: int, retry: bool = False) -> DataFrame:
    """The next ``budget`` records, by key, without an earlier attempt (or without a successful one, to retry)."""
    tried = attempts.where("status = 'enriched'") if retry else attempts
    return records.join(tried.select(key), key, "left_anti").orderBy(key).limit(budget)


def ledger(pending_rows: DataFrame, payloads: DataFrame, key: str, text: str, least_words: int = 80) -> DataFrame:
    """``key, status`` of an enrichment round: enriched, no_fulltext (too short) or failed (no payload)."""
    both = pending_rows.select(key).join(payloads.select(key, text), key, "left")
    words = F.size(F.split(F.trim(text), " +"))
    return both.select(key, F.when(F.col(text).isNull(), "failed").when(words < least_words, "no_fulltext").otherwise("enriched").alias("status"))
