"""Column profiles: counts, exact distinct counts, ranges, averages and most frequent values of every column.

A few passes, however many columns: one aggregate without shuffle of rows for counts and ranges, and one for each of a few
types over (column, value) pairs, pre-aggregated before they are shuffled: whole numbers, dates and instants as 64-bit
numbers, floating-point numbers as doubles, all else as text. Only texts are counted value by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from lattica.functions.text import format_grouped, format_stat, round_half_up, utc

#: Most distinct values for which the frequent ones are listed, and how many are.
TOP_LIMIT, TOP_COUNT = 1000, 5

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind(field: T.StructField) -> str:
    """numeric, date or text: what a profile says of a column."""
    return "numeric" if isinstance(field.dataType, NUMERIC) else "date" if isinstance(field.dataType, DATES) else "text"


def _profiled(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _finite(c):
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ranges(df: DataFrame) -> DataFrame:
    """(ord, column_name, row_count, nulls, num_min, num_max, num_avg, date_min, date_max), a row for each column."""
    rows = F.count(F.lit(1))
    aggregates, out = [rows.alias("rows")], []
    for k, f in enumerate(_profiled(df)):
        c, own = F.col(_quoted(f.name)), kind(f)
        aggregates.append(F.count(c).alias(f"filled_{k}"))
        number, date = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
        entry = [number, number, number, date, date]
        if own == "numeric":
            aggregates += [F.min(_finite(c)).alias(f"low_{k}"), F.max(_finite(c)).alias(f"high_{k}"), F.avg(_finite(c)).alias(f"mean_{k}")]
            entry[:3] = [F.col(f"low_{k}"), F.col(f"high_{k}"), round_half_up(F.col(f"mean_{k}"), 2)]
        elif own == "date":
            aggregates += [utc(F.min(c)).alias(f"low_{k}"), utc(F.max(c)).alias(f"high_{k}")]
            entry[3:] = [F.col(f"low_{k}"), F.col(f"high_{k}")]
        names = ("num_min", "num_max", "num_avg", "date_min", "date_max")
        out.append(F.struct(F.lit(k).alias("ord"), F.lit(f.name).alias("column_name"), F.col("rows").alias("row_count"), (F.col("rows") - F.col(f"filled_{k}")).alias("nulls"), *(x.alias(n) for x, n in zip(entry, names))))
    return df.agg(*aggregates).select(F.inline(F.array(*out)))


def _stored(f: T.StructField):
    """(type, column): a column's values in the type in which they are told apart."""
    c = F.col(_quoted(f.name))
    if isinstance(f.dataType, T.IntegralType):
        return "long", c.cast("long")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return "double", c.cast("double")
    if isinstance(f.dataType, T.DateType):
        return "long", F.unix_date(c).cast("long")
    if isinstance(f.dataType, T.TimestampType):
        return "long", F.unix_micros(c)
    if isinstance(f.dataType, T.TimestampNTZType):
        return "timestamp_ntz", c
    return "string", c.cast("string")


def distinct_counts(df: DataFrame, texts: bool = True) -> DataFrame:
    """(ord, distinct) of each column, or of those that aren't stored as text; all NaN are one value, and both zeros. Columns without values have no row."""
    by_type: dict[str, list] = {}
    for k, f in enumerate(_profiled(df)):
        kind, c = _stored(f)
        if texts or kind != "string":
            by_type.setdefault(kind, []).append(F.struct(F.lit(k).alias("ord"), c.alias("value")))
    parts = [df.select(F.explode(F.array(*entries)).alias("e")).filter("e.value IS NOT NULL").select("e.ord", "e.value").distinct().groupBy("ord").agg(F.count(F.lit(1)).alias("distinct")) for entries in by_type.values()]
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "ord int, distinct long")


def frequencies(df: DataFrame, position) -> DataFrame:
    """(ord, value, n, first): how often each non-null value of each column that is stored as text occurs and the least position where."""
    entries = [F.struct(F.lit(k).alias("ord"), c.alias("value")) for k, f in enumerate(_profiled(df)) for kind, c in [_stored(f)] if kind == "string"]
    if not entries:
        return df.sparkSession.createDataFrame([], "ord int, value string, n long, first long")
    pairs = df.select(F.explode(F.array(*entries)).alias("e"), position.alias("position")).filter("e.value IS NOT NULL")
    return pairs.groupBy("e.ord", "e.value").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))


def profile(df: DataFrame, position=None, columns: list[str] | None = None) -> DataFrame:
    """ranges() with distinct and top, an array of (value, count).

    top lists the five most frequent values, ties by first appearance, of text columns with 1 to 1,000 distinct values;
    first appearance goes by the column expression `position`, without one by the value.
    """
    if columns:
        df = df.select(*(_quoted(c) for c in columns), *([position.alias("lattica_position")] if position is not None else []))
        position = F.col("lattica_position") if position is not None else None
    told = df.drop("lattica_position")
    fields = _profiled(told)
    first = position if position is not None else F.lit(0)
    # position may name a column that isn't profiled, so values are taken beside it
    counted = frequencies(df.select(*(F.col(_quoted(f.name)) for f in fields), F.struct(first.alias("at")).alias("lattica_at")), F.col("lattica_at.at"))
    texts = [k for k, f in enumerate(fields) if kind(f) == "text"]
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("n"), "first", "value"))).filter(F.col("rank") <= TOP_COUNT)
    top = ranked.filter(F.col("ord").isin(texts) if texts else F.lit(False)).groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("listed"))
    top = top.select("ord", F.transform("listed", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("top"))
    distinct = distinct_counts(told, texts=False).unionByName(counted.groupBy("ord").agg(F.count(F.lit(1)).alias("distinct")))
    joined = ranges(told).join(distinct, "ord", "left").join(top, "ord", "left")
    return joined.withColumn("distinct", F.coalesce("distinct", F.lit(0).cast("long"))).withColumn("top", F.when(F.col("distinct") <= TOP_LIMIT, F.col("top")))


def distinct(df: DataFrame) -> DataFrame:
    """(ord, column_name, distinct), a row for each column: what profile() says of distinct values, without the rest of its work."""
    names = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(f.name).alias("column_name")) for k, f in enumerate(_profiled(df))))
    listed = df.sparkSession.range(1).select(F.inline(names))
    return listed.join(distinct_counts(df), "ord", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0).cast("long")))


def profile_tables(tables: dict[str, tuple[DataFrame, object]]) -> DataFrame:
    """profile() of several tables with table_name in front; tables gives (table, position) by name."""
    parts = [profile(df, position).select(F.lit(name).alias("table_name"), "*") for name, (df, position) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def top_text() -> F.Column:
    """top as `value (count), ...`."""
    return F.array_join(F.transform("top", lambda x: F.concat(x["value"], F.lit(" ("), format_grouped(x["count"]), F.lit(")"))), ", ")


def bullet() -> F.Column:
    """A column's line in a report."""
    base = F.concat(F.lit("- **"), F.col("column_name"), F.lit("** -- "), format_grouped("distinct"), F.lit(" distinct, "), format_grouped("nulls"), F.lit(" nulls"))
    numbers = F.concat(F.lit(", avg: "), format_stat("num_avg"), F.lit(", range: "), format_stat("num_min"), F.lit(" .. "), format_stat("num_max"))
    dates = F.concat(F.lit(", range: "), F.col("date_min").cast("date").cast("string"), F.lit(" .. "), F.col("date_max").cast("date").cast("string"))
    return F.concat(base, F.when(F.col("num_avg").isNotNull(), numbers).when(F.col("date_min").isNotNull(), dates).otherwise(""), F.coalesce(F.when(F.size("top") > 0, F.concat(F.lit(", top: "), top_text())), F.lit("")))
