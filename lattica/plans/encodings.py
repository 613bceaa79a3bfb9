"""Column encodings in relational form, over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import relational as rel
from lattica.plans.registry import query

_RUNS = "SELECT o_custkey, run, any_value(o_orderstatus) AS value, count(*) AS n, min(o_orderkey) AS start FROM (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))) GROUP BY o_custkey, run"


def _status_runs(table):
    return rel.runs(table("orders"), ["o_custkey"], "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, run, row_number() OVER (PARTITION BY o_custkey, run ORDER BY o_orderkey) - 1 AS at, o_orderstatus AS value FROM (SELECT *, cast(sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS run FROM (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)))")
def rle_expand(table, spark):
    """Runs of each customer's order states, expanded again: the state at each place of each run."""
    rows = rel.expand_runs(_status_runs(table).select("o_custkey", "run", "value", "n"))
    return rows.select("o_custkey", F.col("run").cast("long").alias("run"), F.col("at").cast("long").alias("at"), "value")


@query(f"SELECT o_custkey, cast(run AS BIGINT) AS run, cast(n AS BIGINT) AS n, cast(coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({_RUNS})")
def running_offset(table, spark):
    """Where each run begins in its customer's orders."""
    return rel.running_offset(_status_runs(table), ["o_custkey"], "run", "n").select("o_custkey", "run", "n", "offset")


@query("SELECT event_id, user_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), (SELECT max(event_id) + 1 FROM events)) AS until FROM events")
def lead_with_default(table, spark):
    """The user's next event, or the end of all."""
    events = table("events").select("event_id", "user_id")
    end = events.agg((F.max("event_id") + 1).alias("end"))
    return rel.next_or(events.crossJoin(F.broadcast(end)), ["user_id"], "event_id", "event_id", F.col("end")).select("event_id", "user_id", "until")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) - 1 + 3 AS data_id FROM part")
def dense_id_assign(table, spark):
    """Ids from 3 within a brand, by type and key."""
    return rel.dense_ids(table("part").select("p_partkey", "p_brand", "p_type"), ["p_type", "p_partkey"], 3, ["p_brand"]).select("p_partkey", "p_brand", "data_id")


@query("SELECT o_custkey, string_agg(cast(o_orderkey % 97 + 5 AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def bit_unpack(table, spark):
    """Each customer's order numbers, packed into seven bits and unpacked again."""
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 97).alias("v"))))
    packed = table("orders").groupBy("o_custkey").agg(F.transform(listed, lambda x: x["v"]).alias("values"))
    words = packed.select("o_custkey", F.size("values").alias("n"), rel.bit_pack(F.col("values"), 7).alias("words"))
    return words.select("o_custkey", F.array_join(F.slice(rel.bit_unpack(F.col("words"), 7, 5), F.lit(1), F.col("n")), ",").alias("ids"))


@query("SELECT o_custkey, string_agg(cast(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 97 + 5 ELSE 50 + o_custkey % 3 END AS VARCHAR), ',' ORDER BY o_orderkey % 2, o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def hybrid_decode(table, spark):
    """Segments of a packed stretch, for a customer's even orders, and a run, for the odd ones."""
    even = F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.struct("o_orderkey", (F.col("o_orderkey") % 97).alias("v")))))
    odd = F.count_if(F.col("o_orderkey") % 2 == 1)
    told = table("orders").groupBy("o_custkey").agg(F.transform(even, lambda x: x["v"]).alias("values"), odd.alias("odd"))
    entry = lambda value, n: F.struct(value.cast("long").alias("data_value"), n.cast("long").alias("repeat_value"))
    primary = F.array(entry(F.lit(0xFFFFFFFF), F.size("values")), entry(50 + F.col("o_custkey") % 3, F.col("odd")))
    sub = F.when(F.size("values") > 0, rel.bit_pack(F.col("values"), 7)).otherwise(F.array().cast("array<bigint>"))
    segments = told.select("o_custkey", primary.alias("primary"), sub.alias("sub"))
    return segments.select("o_custkey", F.array_join(rel.hybrid_decode(F.col("primary"), F.col("sub"), 7, F.lit(5).cast("long")), ",").alias("ids"))


@query("SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS at, p_name AS value FROM part")
def nul_split(table, spark):
    """Names of a brand written into one page, each ended by a NUL, and read again."""
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    pages = table("part").groupBy("p_brand").agg(F.transform(listed, lambda x: F.concat(x["p_name"], F.lit("\x00"))).alias("names")).select("p_brand", F.array_join("names", "").alias("page"))
    return pages.select("p_brand", F.posexplode(rel.nul_split(F.col("page"))).alias("at", "value")).withColumn("at", F.col("at").cast("long"))
