"""Immutable sorted runs in levels, listed in a manifest in the shared folder.

A run is a Parquet table bucketed by ``key`` and sorted by ``key`` and ``then``, so runs of one store are joined on both
columns bucket by bucket, without an exchange. Every commit writes a new manifest (level, place and columns of
each run) as a folder of its own; a reader takes the latest complete one, so a store is reopened by its path in any
later session, and a job that dies before its commit leaves the store as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..storage import new_path

#: Lets a join on key and then use the buckets of key alone; the optimizer's default deals both sides out again.
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def by_bucket(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside use buckets of a part of their keys."""
    before = spark.conf.get(_CO_PARTITION, "true")
    spark.conf.set(_CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(_CO_PARTITION, before)


@dataclass(frozen=True)
class Run:
    name: str
    path: str
    columns: str
    level: int = 0


class RunStore:
    """Runs by level; ``fanout`` runs of a level are merged into one of the next."""

    def __init__(self, spark: SparkSession, path: str | None = None, key: str = "anchor", then: str = "span", fanout: int = 4, buckets: int = 0):
        self.spark, self.key, self.then, self.fanout = spark, key, then, fanout
        self.path = path or new_path(spark, "runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs = 0, []
        found = self._manifests()
        if found:
            self.version = max(found)
            for r in spark.read.json(self._manifest(self.version)).orderBy("place").collect():
                self.buckets = r.buckets
                if r.name:
                    self.runs.append(self._registered(Run(f"run_{uuid.uuid4().hex}", r.path, r.columns, r.level)))

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version}"

    def _folder(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        place, files = self._folder(self.path)
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        done = [n for n in names if n.startswith("manifest-") and files.exists(self._folder(f"{self.path}/{n}/_SUCCESS")[0])]
        return [int(n.split("-")[1]) for n in done]

    def _registered(self, run: Run) -> Run:
        self.spark.sql(
            f"CREATE TABLE {run.name} ({run.columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}, {self.then}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{run.path}'"
        )
        return run

    def write(self, rows: DataFrame, level: int = 0, dealt: bool = False) -> Run:
        """A run that no manifest lists yet. ``dealt``: rows are in buckets already."""
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        run = Run(f"run_{path.rsplit('-', 1)[1]}", path, ", ".join(f"{n} {t}" for n, t in rows.dtypes), level)
        placed = rows if dealt else rows.repartition(self.buckets, self.key)
        ordered = placed.sortWithinPartitions(self.key, self.then)
        ordered.write.bucketBy(self.buckets, self.key).sortBy(self.key, self.then).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(run.name)
        return run

    def table(self, run: Run) -> DataFrame:
        return self.spark.table(run.name)

    @property
    def tables(self) -> list[DataFrame]:
        return [self.table(r) for r in self.runs]

    def add(self, run: Run, merged: Callable[[list[DataFrame]], DataFrame]) -> None:
        """List ``run``; while a level has ``fanout`` runs, replace them by ``merged`` of them. Old files go after the commit."""
        self.runs.append(run)
        old: list[Run] = []
        while True:
            level = self.runs[-1].level
            same = [r for r in self.runs if r.level == level]
            if len(same) < self.fanout:
                break
            with by_bucket(self.spark):
                new = self.write(merged([self.table(r) for r in same]), level + 1)
            self.runs = [r for r in self.runs if r.level != level] + [new]
            old += same
        self._commit()
        for r in old:
            self.drop(r)

    def _commit(self) -> None:
        self.version += 1
        rows = [(k, r.name, r.path, r.columns, r.level, self.buckets) for k, r in enumerate(self.runs)] or [(0, None, None, None, 0, self.buckets)]
        listed = self.spark.createDataFrame(rows, "place int, name string, path string, columns string, level int, buckets int")
        listed.coalesce(1).write.json(self._manifest(self.version))
        for version in self._manifests():
            if version < self.version - 1:
                place, files = self._folder(self._manifest(version))
                files.delete(place, True)

    def drop(self, run: Run) -> None:
        """Delete a run's table and files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")
        place, files = self._folder(run.path)
        files.delete(place, True)

    def close(self) -> None:
        """Forget the session's tables; the store stays and can be opened again."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r.name}")
        self.runs = []

    def delete(self) -> None:
        """Delete the store."""
        self.close()
        place, files = self._folder(self.path)
        files.delete(place, True)
