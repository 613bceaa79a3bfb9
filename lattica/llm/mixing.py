"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1): piecewise linear, through its given weight at the
middle. Its share of the mix is the schedule's integral; capped shares are filled up from the others. A source's words
are laid out epoch after epoch in an order that its ids' hashes give, and the cumulative demand curve of the source,
inverted, tells at which training position a document is due. The rows are range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Size of the mix as a share of all sizes; most that a source gives, in sizes of its own.
TOTAL, MOST = 1.5, 2.0
#: Hash ranges of a source within which documents are summed on their own; a source with a third of all rows is spread over all of them.
BINS = 4096
#: How a source's weight moves over training: it begins at (1 + k) and ends at (1 - k) of its weight, k by rank, repeating.
SLOPES = (-0.5, 0.0, 0.5)

SIZE_PATTERN = "[^\\x20\\x09-\\x0D]+"


def capped_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(key, source, source_size, weight, slope, target): targets share total * all sizes by weight, none over most * its size.

    What a capped source can't take is shared again by weight among the others until none is above its cap. Filling is
    solved at once: in ascending order of cap / weight, sources are capped as long as the level that remains for the
    rest is at or above their own. Sources rank by code point, null last. The ranking runs over one row for each source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    count = len(weights)
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), ((F.row_number().over(rank) - 1) % count + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick(weights)).withColumn("slope", pick([SLOPES[k % len(SLOPES)] for k in range(count)]))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    all_rows = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.least(F.lit(total) * F.sum("source_size").over(all_rows), F.sum("cap").over(all_rows))
    left = wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / weight_left).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source that isn't capped holds for all that follow
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * first["level"]))
    return leveled.select("key", "source", "source_size", "weight", "slope", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, position) and the columns in `carry`, in ascending order of position.

    size counts words of `[^\\x20\\x09-\\x0D]+`; null and empty texts have 0 and are taken 0 times. taken is what the mix
    takes of the document: whole passes, as many for all documents of a source but one more for those that come first in
    the source's order until its target is met, so a source misses its target by less than one document. position is
    the training position in [0, 1] of the document's first pass, null if it isn't taken. A null source is a source of
    its own; null ids, rows that share an id and ties are ordered by their text's hash; equal rows are
    interchangeable. The order comes from hashes of id and text, and of what is carried, so reruns agree. Other columns of
    docs are not read.
    """
    return _plan(docs, id_col, text_col, source_col, weights, total, most, carry).orderBy(F.col("position").asc_nulls_last(), F.col(id_col))


def _plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, carry: tuple[str, ...] = (), laid_out: bool = False) -> DataFrame:
    """What mix() returns, in no order; laid_out adds mix_start, the source's words before the document, and mix_slope."""
    own = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(SIZE_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("turn"),
        *(F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)),
    ).withColumn("bin", F.shiftrightunsigned("turn", 52).cast("int"))
    own = own.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # never null
    bins = own.groupBy("key", "source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = capped_targets(bins.groupBy("key", "source").agg(F.sum("bin_size").alias("source_size")), weights, total, most)
    in_source = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select("key", "bin", F.coalesce(F.sum("bin_size").over(in_source), F.lit(0)).alias("bin_start")).join(targets.drop("source"), "key")
    # maps and variants have no hash: rows that differ in them only are interchangeable
    ties = [c for c, kind in own.dtypes if c.startswith("carry_") and "map<" not in kind and "variant" not in kind]
    in_bin = Window.partitionBy("key", "bin").orderBy("turn", "id", "size", *([F.xxhash64(*ties)] if ties else [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("inside", F.coalesce(F.sum("size").over(in_bin), F.lit(0))).join(offsets, ["key", "bin"])
    start = F.col("bin_start") + F.col("inside")
    # passes that the source makes in whole, and words of the last one; a document whose middle lies before its end is in it
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - whole * F.col("source_size")
    in_last = (start + F.col("size") / 2 < rest) & (whole < most)
    passes = F.when(F.col("size") == 0, F.lit(0)).otherwise(whole + in_last.cast("int"))
    place = place_of(start, F.col("target"), F.col("slope"))
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * passes).cast("long").alias("taken"),
        F.when(passes > 0, place).alias("position"),
        *([start.alias("mix_start"), F.col("slope").alias("mix_slope")] if laid_out else []),
        *(F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)),
    )


def place_of(words, target, slope):
    """Where in training a source of this target and slope has used so many words: its demand up to t is target * (t * (1 + slope) - slope * t * t), inverted. What lies beyond the target, by less than one document, stands at the end."""
    share = F.least(F.lit(1.0), F.when(target > 0, words / target).otherwise(0.0))
    curved = ((1 + slope) - F.sqrt(F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * share))) / (2 * slope)
    return F.when(slope == 0, share).otherwise(curved)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """docs with each row as often as the mix takes it (0 times: left out), range-sorted by training position.

    A source's passes follow one another: the k-th pass of a document stands where the source's demand reaches the words of
    k whole passes and those before the document, so all positions lie in [0, 1] and the curriculum holds for every
    pass. Each row has the passes and the positions that mix() gives it, also where its id is null or shared. Columns are
    those of docs.
    """
    whole = docs.select(F.col(id_col), F.col(text_col), F.col(source_col), F.struct("*").alias("mix_doc"))
    plan = positions(_plan(whole, id_col, text_col, source_col, carry=("mix_doc",), laid_out=True, **settings))
    spark = docs.sparkSession
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return plan.select("mix_doc", "at").repartitionByRange(pieces, "at").sortWithinPartitions("at").select("mix_doc.*")


def positions(plan: DataFrame) -> DataFrame:
    """A row for each pass of each document of a plan that is laid out, with its number in `pass` and its training position in `at`."""
    passes = F.sequence(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")) - 1)
    every = plan.filter("taken > 0").withColumn("pass", F.explode(passes))
    return every.withColumn("at", place_of(F.col("mix_start") + F.col("pass") * F.col("source_size"), F.col("target"), F.col("mix_slope")))
