"""Cutting lineage in loops, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, local mode takes one of its own; a cluster can't."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lotlens-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; removed by discard() or when the session ends."""
    path = f"{shared_dir(df.sparkSession)}/lotlens-loop-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.settled_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.settled_at)


def small_or_none(df: DataFrame, rows: int) -> DataFrame | None:
    """The table with a broadcast hint if it has at most that many rows, else nothing."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before; the folder is scratch space
        return
