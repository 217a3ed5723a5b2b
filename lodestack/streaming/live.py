"""Streams that keep a view current by touching only what a micro-batch changes, and sinks that survive being killed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import new_path


class BucketedView:
    """Sums by key, kept in buckets: a micro-batch rewrites the buckets of the keys it touches and no others.

    ``sums`` name columns that deltas add to, ``latest`` columns of which the greatest counts. Batch n writes version n of a
    bucket from the versions before n, so a batch that is run again after a crash gives the same. The last two versions
    of a bucket are kept.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, sums: tuple[str, ...], latest: tuple[str, ...] = (), buckets: int = 16):
        self.spark, self.path, self.key, self.sums, self.latest, self.buckets = spark, path, key, sums, latest, buckets
        self.schema = StructType.fromDDL(schema)

    def _folder(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, list[int]]:
        """Complete versions of each bucket, ascending."""
        place, files = self._folder()
        out: dict[int, list[int]] = {}
        if files.exists(place):
            for status in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/bucket=*")) or []:
                version, bucket = (int(part.split("=")[1]) for part in status.getPath().toString().rsplit("/", 2)[-2:])
                if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={version}/_SUCCESS")):
                    out.setdefault(bucket, []).append(version)
        return {b: sorted(v) for b, v in out.items()}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def table(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The view as it is, or as it was before a version; of all buckets or some."""
        current = {b: [v for v in versions if before is None or v < before] for b, versions in self._versions().items()}
        return self._read([f"{self.path}/version={v[-1]}/bucket={b}" for b, v in current.items() if v and (only is None or b in only)])

    def add(self, deltas: DataFrame, number: int) -> set[int]:
        """Add a micro-batch of deltas as version ``number``; gives the buckets that it touched."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        sums = [F.sum(c).cast(self.schema[c].dataType).alias(c) for c in self.sums]
        change = deltas.groupBy(self.key).agg(*sums, *[F.max(c).alias(c) for c in self.latest]).persist()
        touched = {r.bucket for r in change.select(bucket.alias("bucket")).distinct().collect()}  # at most ``buckets`` rows
        if touched:
            both = self.table(number, touched).unionByName(change.select(*self.schema.names))
            after = both.groupBy(self.key).agg(*sums, *[F.max(c).alias(c) for c in self.latest])
            after.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={number}")
        change.unpersist()
        for b, versions in self._versions().items():
            for old in versions[:-2]:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={old}/bucket={b}")
                self._folder()[1].delete(place, True)
        return touched


_DELTAS = "claim string, support long, contradict long, papers long, last_seen long"


def stance_deltas(stances: DataFrame) -> DataFrame:
    """What a stream of ``claim, paper, stance, seen`` changes in the sums by claim: a paper's old stance goes out, its new one comes in.

    The state is one stance for each claim and paper. The row of greatest ``seen`` counts; an older one, and one
    without a stance, changes nothing.
    """

    def change(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else (None, None)
        before = held
        for row in pd.concat(list(batches)).sort_values("seen", kind="stable").itertuples():
            if seen is None or row.seen >= seen:
                held, seen = row.stance, row.seen
        state.update((held, int(seen)))
        side = lambda name: [(held == name) - (before == name)]
        yield pd.DataFrame({"claim": [key[0]], "support": side("SUPPORT"), "contradict": side("CONTRADICT"), "papers": [int(before is None)], "last_seen": [int(seen)]})

    rows = stances.where("stance is not null and claim is not null and paper is not null and seen is not null")
    rows = rows.select(F.col("claim").cast("string").alias("claim"), F.col("paper").cast("string").alias("paper"), F.col("stance").cast("string").alias("stance"), F.col("seen").cast("long").alias("seen"))
    return rows.groupBy("claim", "paper").applyInPandasWithState(change, _DELTAS, "stance string, seen long", "append", "NoTimeout")


def live_contradictions(spark: SparkSession, stances: DataFrame, path: str, after_batch: Callable[[int], None] | None = None, buckets: int = 16) -> BucketedView:
    """Feed all that the stream ``stances`` has now to the view at ``path``, which a later run continues."""
    view = BucketedView(spark, f"{path}/view", _DELTAS, "claim", ("support", "contradict", "papers"), ("last_seen",), buckets)

    def add(batch: DataFrame, number: int) -> None:
        view.add(batch, number)
        if after_batch:
            after_batch(number)

    writer = stance_deltas(stances).writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(add).start().awaitTermination()
    return view


def disputed(view: DataFrame) -> DataFrame:
    """Claims with papers for and against them."""
    return view.where("support > 0 and contradict > 0")


def resumable_vectors(
    spark: SparkSession, chunks: DataFrame, path: str, model: str, encode: Callable[[DataFrame], DataFrame], checkpoint: str | None = None,
    key: str = "chunk", after_batch: Callable[[int], None] | None = None,
) -> DataFrame:
    """Vectors of all chunks of a stream by ``model``, each once, however often the job is killed and run again; gives the table.

    The table is its own ledger: a micro-batch encodes those of its chunks that no other batch has written for this model. It is
    written to a folder named by checkpoint and batch number, so a batch that is run again replaces what it wrote.
    A new checkpoint reads the stream anew and finds everything done; another model has a table of its own.
    """
    marks = checkpoint or f"{path}/checkpoint-{model}"
    run = hashlib.sha1(marks.encode()).hexdigest()[:12]
    base = f"{path}/model={model}"
    shape: list[StructType] = []

    def done(but: str | None = None) -> DataFrame | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return None
        names = [s.getPath().getName() for s in files.listStatus(place)]
        whole = [f"{base}/{n}" for n in names if n != but and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS"))]
        return spark.read.schema(shape[0]).parquet(*whole) if whole and shape else None

    def write(batch: DataFrame, number: int) -> None:
        name = f"batch={run}-{number}"
        fresh = batch.dropDuplicates([key])
        encoded = encode(fresh)
        shape[:] = [encoded.schema]
        before = done(name)
        if before is not None:
            encoded = encode(fresh.join(before.select(key), key, "left_anti"))
        encoded.write.mode("overwrite").parquet(f"{base}/{name}")
        if after_batch:
            after_batch(number)

    chunks.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not shape:  # nothing new: the table's own schema
        place = spark._jvm.org.apache.hadoop.fs.Path(base)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.read.option("recursiveFileLookup", "true").parquet(base)
        return encode(spark.createDataFrame([], chunks.schema))
    return done()


def new_state(spark: SparkSession, label: str) -> str:
    """A folder for a stream that nothing continues."""
    return new_path(spark, label)
