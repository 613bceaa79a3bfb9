"""Tables written part-way in the folder that driver and executors share."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from lattica.sources import folders

#: Folders of the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; see folders.shared()."""
    return folders.shared(spark)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables that written() writes inside are removed at the end, but those to be kept, which go to the scope outside."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_folder(spark, path)


#: Lets Spark delete a plan's shuffle files when its execution is over, not when the driver next collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, codec: str = "zstd", partition_by: str | None = None) -> None:
    """Write df as Parquet at path; what it shuffled is deleted afterwards."""
    spark = df.sparkSession
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        writer = df.write.option("compression", codec)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def written(df: DataFrame, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """df as a table written in the shared folder and read back: later steps start from it, and a lost executor loses nothing. keep: it outlives the innermost scope."""
    spark = df.sparkSession
    path = shared_folder(spark)
    own = _SCOPES[: len(_SCOPES) - keep]
    if own:
        own[-1].append(path)
    write(df, path, codec)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Remove a table that written() has written, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        drop_folder(table.sparkSession, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer knows of a plan's size; 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else 0


def pieces_for(df: DataFrame, each: int, least: int = 16) -> int:
    """How many pieces of about `each` input bytes a plan makes: grows with the input."""
    spark = df.sparkSession
    known = -(-plan_bytes(df) // each)
    return max(least, known, 0 if known else 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
