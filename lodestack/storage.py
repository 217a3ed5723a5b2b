"""Tables kept between jobs in the folder that all executors share.

Writing a table and reading it back cuts the lineage, survives the loss of an executor and
gives later jobs real sizes. The folder is the one named in ``spark.checkpoint.dir``; only a
local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that are broadcast after being counted.
FEW = 1_000_000

#: Rows that a task of a join or an aggregate gets, on average.
TASK_ROWS = 2_000_000

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster whose administrator named none."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="spark-stage-")
    return f"file://{_local_root}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/lodestack/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under a new name in the shared folder and return a scan of it."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, to be broadcast if a count finds no more than ``most`` rows; so it should be staged or cheap."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, in enough parts by ``keys`` that none gets more than ``TASK_ROWS`` on average.

    Unchanged where the session's shuffles have as many parts anyhow.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def discard(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` scans; it must not be read afterwards."""
    spark = df.sparkSession
    root = shared_root(spark)
    prefix = root.split("://", 1)[-1].lstrip("/")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if f"{prefix}/lodestack/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
