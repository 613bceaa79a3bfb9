"""Lookups, windows and encodings that the column store's readers need, in relational form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_by(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """The first row of each group by `order`; one aggregate, no sort."""
    row = F.min_by(F.struct(*df.columns), F.col(order)).alias("row")
    return df.groupBy(*group).agg(row).select("row.*")


def last_by(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """The last row of each group by `order`: what a map holds after all rows were put into it."""
    row = F.max_by(F.struct(*df.columns), F.col(order)).alias("row")
    return df.groupBy(*group).agg(row).select("row.*")


def left_with_defaults(df: DataFrame, other: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """A left join in which columns of rows without a partner have the defaults."""
    joined = df.join(other, on, "left")
    return joined.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in joined.columns))


def orphans(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows whose key the other table doesn't have."""
    return df.join(other.select(on), on, "left_anti")


#: Plans under so many bytes are numbered in one task; ranges into which larger ones are cut.
ONE_TASK_BYTES, NUMBER_RANGES = 32 << 20, 1024


def dictionary(df: DataFrame, column: str, least: int = 0) -> DataFrame:
    """(data_id, value): ids from `least` for the distinct values in ascending order."""
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return dense_ids(values, ["value"], least).select("data_id", "value")


def decode(ids: DataFrame, words: DataFrame, id_column: str) -> DataFrame:
    """Rows with their value; ids that the dictionary doesn't have give null."""
    return ids.join(words, ids[id_column] == words["data_id"], "left").drop("data_id")


def dense_ids(df: DataFrame, order: list[str], least: int = 0, part: list[str] | None = None, name: str = "data_id") -> DataFrame:
    """Ids in ascending order of `order`, from `least`, in each part or in all. Rows alike in `order` are numbered in any order."""
    if part:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1 + least).cast("long"))
    if 0 < _plan_bytes(df) <= ONE_TASK_BYTES:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1 + least).cast("long"))
    return _numbered_by_ranges(df, order, least, name)


def _plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes a plan's size for."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _numbered_by_ranges(df: DataFrame, order: list[str], least: int, name: str) -> DataFrame:
    """dense_ids() of any number of rows: each range of `order` is numbered on its own, after the rows of the ranges before it.

    The bounds are the keys whose hashes come first, so they are a sample that is the same each time the plan runs; as
    many bounds as ranges, of any number of rows, reach the driver.
    """
    key = F.struct(*order)
    chosen = df.select(key.alias("key")).orderBy(F.xxhash64("key")).limit(NUMBER_RANGES - 1).select(F.sort_array(F.collect_set("key")).alias("bounds"))
    bounded = df.crossJoin(F.broadcast(chosen)).withColumn("numbered_range", F.size(F.filter("bounds", lambda b: b <= key))).drop("bounds")
    sizes = bounded.groupBy("numbered_range").agg(F.count(F.lit(1)).alias("numbered_count"))
    before = F.sum("numbered_count").over(Window.orderBy("numbered_range")) - F.col("numbered_count")
    offsets = sizes.select("numbered_range", before.alias("numbered_before"))
    inside = F.row_number().over(Window.partitionBy("numbered_range").orderBy(*order))
    told = bounded.withColumn("numbered_inside", inside).join(F.broadcast(offsets), "numbered_range")
    return told.withColumn(name, (F.col("numbered_before") + F.col("numbered_inside") - 1 + least).cast("long")).drop("numbered_range", "numbered_before", "numbered_inside")


def running_offset(df: DataFrame, part: list[str], order: str, size: str, name: str = "offset") -> DataFrame:
    """The sum of `size` over the rows before."""
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def next_or(df: DataFrame, part: list[str], order: str, value: str, default, name: str = "until") -> DataFrame:
    """The next row's value, for the last row the default."""
    return df.withColumn(name, F.coalesce(F.lead(value).over(Window.partitionBy(*part).orderBy(order)), default))


def runs(df: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Run-length encoding: (part, run, value, n, start) of equal neighbours in each part."""
    over = Window.partitionBy(*part).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(over))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(over) == 1, 1).otherwise(changed)
    marked = df.select(*part, order, value, first.alias("new")).withColumn("run", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*part, "run").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("n"), F.min(order).alias("start"))


def expand_runs(df: DataFrame, value: str = "value", n: str = "n") -> DataFrame:
    """Rows of runs repeated n times, numbered from 0 in `at`."""
    others = [c for c in df.columns if c not in (value, n)]
    return df.select(*others, F.posexplode(F.array_repeat(F.col(value), F.col(n).cast("int"))).alias("at", value))


def packed_width(most: Column) -> Column:
    """Bits that the largest number takes, one at least."""
    return F.greatest(F.lit(1), F.length(F.bin(most))).cast("int")


def bit_pack(values: Column, width: int) -> Column:
    """An array of small numbers as an array of 64-bit words, the first number in the lowest bits; a word has 64 div width of them."""
    each = 64 // width
    words = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / each).cast("int"))

    def word(k: Column) -> Column:
        own = F.slice(values, k * each + 1, each)
        return F.aggregate(F.transform(own, lambda v, j: F.call_function("shiftleft", v.cast("long"), j * width)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.transform(words, word)


def bit_unpack(words: Column, width: int, least: Column | int = 0) -> Column:
    """The numbers of 64-bit words, 64 div width in each, plus `least`; the last word's may be padding."""
    if not 0 < width <= 64:
        raise ValueError("a width is 1 to 64 bits")
    mask = (1 << width) - 1 if width < 64 else -1
    base = least if isinstance(least, Column) else F.lit(least)

    def numbers(word: Column) -> Column:
        shifts = F.array(*(F.lit(width * j) for j in range(64 // width)))
        return F.transform(shifts, lambda s: F.call_function("shiftrightunsigned", word, s).bitwiseAND(F.lit(mask).cast("long")) + base)

    return F.flatten(F.transform(words, numbers))


def hybrid_decode(primary: Column, sub: Column, width: int, least: Column) -> Column:
    """The ids of a column segment: its primary entries are runs (data_value, repeat_value), or, where data_value plus the packed offset so far is all ones in 32 bits, stretches of the packed numbers."""
    packed = bit_unpack(sub, width, least)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("used"))

    def step(state: Column, entry: Column) -> Column:
        is_packed = entry["data_value"] + state["used"] == F.lit(0xFFFFFFFF)
        stretch = F.slice(packed, (state["used"] + 1).cast("int"), entry["repeat_value"].cast("int"))
        run = F.array_repeat(entry["data_value"], entry["repeat_value"].cast("int"))
        return F.struct(F.concat(state["out"], F.when(is_packed, stretch).otherwise(run)).alias("out"), (state["used"] + F.when(is_packed, entry["repeat_value"]).otherwise(0)).cast("bigint").alias("used"))

    return F.aggregate(primary, start, step, lambda s: s["out"])


def nul_split(text: Column) -> Column:
    """The strings of a page, each ended by a NUL."""
    parts = F.split(text, "\\x00")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def row_slice(df: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    """`count` rows from `start` in ascending order; fewer where the table ends."""
    return df.orderBy(*order).offset(max(0, start)).limit(max(0, count))


def ragged_length(sizes: DataFrame, column: str, group: list[str]) -> DataFrame:
    """Rows of a table whose columns have different lengths: the longest one's."""
    return sizes.groupBy(*group).agg(F.max(column).alias("row_count"))
