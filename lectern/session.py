"""Session helpers: a tuned builder, shipping the package, and durable tables in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def build(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession, batch_bytes: int = 16 << 20) -> SparkSession:
    """Let Python workers import this package (one started from another folder too), and bound Arrow batches.

    A cluster gets the package by ``--py-files``; the path below only matters where the driver's disk is visible.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset and the
    master is local. On a cluster an unset one raises: executors don't see each other's disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def pieces(df: DataFrame, megabytes: int = 4) -> int:
    """Partitions for a shuffle of ``df``: the session's number, or more where the planner's estimate of its stored size
    is over so many megabytes each. So a task's share, and its memory, stay as they are when tables grow."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // (megabytes << 20))))


def spread(df: DataFrame, *keys: str, number: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to ``number`` or :func:`pieces` partitions, which windows and groups of these keys keep."""
    return df.repartition(number or pieces(df), *keys)


def durable(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``durable`` wrote for these tables, which nothing reads any more."""
    for df in tables:
        path = df.__dict__.get("durable_path")
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
