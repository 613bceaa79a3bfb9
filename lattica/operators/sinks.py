"""Exports of tables as CSV and Parquet folders, and of many tables as one archive."""

from __future__ import annotations

import re
import zipfile
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lattica.functions import text as tx

#: Rows of a file.
CHUNK = 50_000
FORMATS = ("csv", "parquet")


def csv_ready(df: DataFrame) -> DataFrame:
    """Columns in the export's form: dates and timestamps as ISO 8601 in UTC, doubles in their shortest text, decimals without trailing zeros; others as they are."""

    def ready(f: T.StructField) -> Column:
        c = F.col(_name(f.name))
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return tx.iso_timestamp(c)
        if isinstance(f.dataType, T.FloatType):
            return tx.shortest_number(c.cast("string"))  # its own digits, not those of the double beside it
        if isinstance(f.dataType, T.DoubleType):
            return tx.shortest_number(c)
        if isinstance(f.dataType, T.DecimalType) and f.dataType.scale:
            return F.regexp_replace(c.cast("string"), "\\.?0+$", "")
        return c

    return df.select(*(ready(f).alias(f.name) for f in df.schema))


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_csv(df: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """CSV by RFC 4180: a header in each file, quotes doubled, null empty; written by all tasks, `chunk` rows to a file."""
    csv_ready(df).write.option("maxRecordsPerFile", chunk).csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="error")


def read_csv(spark, path: str, schema: T.StructType) -> DataFrame:
    """What write_csv() wrote. Empty text comes back as null: the format doesn't tell them apart."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of each row, without the header."""
    ready = csv_ready(df)
    return ready.select(F.concat_ws(",", *(tx.csv_field(_name(c)) for c in ready.columns)).alias("line"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def file_names(tables: list[str]) -> list[str]:
    """Names of the tables' files: sanitized, `table_N` where nothing is left, numbered where two would be the same."""
    seen: Counter[str] = Counter()
    out = []
    for k, name in enumerate(tables, 1):
        base = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name or "") or f"table_{k}"
        seen[base.lower()] += 1
        out.append(base if seen[base.lower()] == 1 else f"{base}_{seen[base.lower()]}")
    return out


def export_zip(tables: dict[str, DataFrame], path: str, kind: str = "csv") -> list[str]:
    """One archive with a file for each table; it is for downloads. Rows stream through the driver, a partition of at most CHUNK rows at a time, so no table is held there. Returns the members."""
    if kind not in FORMATS:
        raise ValueError(f"unknown export format: {kind}")
    names = [f"{n}.{kind}" for n in file_names(list(tables))]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as archive:
        for name, df in zip(names, tables.values()):
            with archive.open(name, "w", force_zip64=True) as out:
                if kind == "csv":
                    header = spark_header(df)
                    out.write(header.encode())
                    for row in csv_lines(df).toLocalIterator():
                        out.write(row["line"].encode() + b"\n")
                else:
                    _write_parquet_member(df, out)
    return names


def _write_parquet_member(df: DataFrame, out) -> None:
    """A table as one Parquet file, a row group for each batch of rows that the tasks have encoded."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def encode(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    with pq.ParquetWriter(out, schema) as writer:
        for row in df.mapInArrow(encode, "batch binary").toLocalIterator():
            table = pa.ipc.open_stream(row["batch"]).read_all()
            if table.num_rows:
                writer.write_table(table.cast(schema))


def spark_header(df: DataFrame) -> str:
    """The first line of a CSV export."""
    quoted = ('"' + c.replace('"', '""') + '"' if re.search('[,"\n\r]', c) else c for c in df.columns)
    return ",".join(quoted) + "\n"
