"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, a temporary folder, which goes with the process, serves a session on one machine; on a cluster it raises, as executors wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table written in a shared folder and read back, so what reads it several times computes it once."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file at any path that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
