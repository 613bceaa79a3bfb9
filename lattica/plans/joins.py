"""The joins of the store's schema resolution, over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import catalog
from lattica.operators import relational as rel
from lattica.plans.registry import query


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_inner_parent(table, spark):
    """Children with their parent's columns."""
    lines, orders = table("lineitem"), table("orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "o_orderpriority")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins_lookup(table, spark):
    """Each user's last event."""
    return rel.last_by(table("events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("SELECT d.doc_id, lang, coalesce(quality, 0) AS quality, coalesce(toxic, 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left_defaults(table, spark):
    """Documents with their ratings, or defaults."""
    return rel.left_with_defaults(table("documents").select("doc_id", "lang"), table("labels"), "doc_id", {"quality": 0, "toxic": 1})


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 0) ON n_regionkey = r_regionkey")
def join_left_multihop(table, spark):
    """Two left joins in a row; some nations and regions are missing."""
    nation, region = table("nation").filter("n_nationkey % 3 > 0"), table("region").filter("r_regionkey > 0")
    out = table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "n_name", "r_name")


@query(
    "SELECT r_name, n_name, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL".replace("floor(", "cast(floor(").replace("+ 0.5) AS", "+ 0.5) AS BIGINT) AS")
)
def snowflake_chain(table, spark):
    """Revenue over the whole chain of eight tables; the optimizer orders it."""
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    out = lines.join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = out.join(table("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).join(table("supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    revenue = F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).cast("long")
    return out.groupBy("r_name", "n_name").agg(revenue.alias("revenue"), F.count(F.lit(1)).alias("n"))


@query(
    "SELECT c_custkey AS rel_id, a.n_name AS from_table, b.n_name AS to_table, x.r_name AS from_column, y.r_name AS to_column FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON (c_custkey % 30) = b.n_nationkey LEFT JOIN region x ON (c_custkey % 6) = x.r_regionkey LEFT JOIN region y ON (c_custkey % 7) = y.r_regionkey"
)
def relationship_resolve(table, spark):
    """Both ends of a relationship named from the same tables; columns may be missing, tables not."""
    ids = table("customer").select(F.col("c_custkey").alias("rel_id"), F.col("c_nationkey").alias("from_table_id"), (F.col("c_custkey") % 30).cast("int").alias("to_table_id"), (F.col("c_custkey") % 6).cast("int").alias("from_column_id"), (F.col("c_custkey") % 7).cast("int").alias("to_column_id"))
    names = table("nation").select(F.col("n_nationkey").alias("table_id"), F.col("n_name").alias("name"))
    columns = table("region").select(F.col("r_regionkey").alias("column_id"), F.col("r_name").alias("name"))
    return catalog.resolve_relationships(ids, names, columns)


@query("SELECT r_name AS role, string_agg(n_name || '=' || filter, '|' ORDER BY n_name) AS filters FROM (SELECT r_name, n_name, 'key ' || n_nationkey AS filter FROM region JOIN nation ON n_regionkey = r_regionkey) GROUP BY r_name")
def role_permissions(table, spark):
    """Roles with their filters: regions have one for each nation."""
    roles = table("region").select(F.col("r_regionkey").alias("role_id"), F.col("r_name").alias("role"))
    permissions = table("nation").select(F.col("n_regionkey").alias("role_id"), F.col("n_nationkey").alias("table_id"), F.concat(F.lit("key "), F.col("n_nationkey")).alias("filter_expression"))
    names = table("nation").select(F.col("n_nationkey").alias("table_id"), F.col("n_name").alias("name"))
    told = catalog.role_filters(roles, permissions, names)
    return told.select("role", F.array_join(F.transform("filters", lambda x: F.concat_ws("=", x["name"], x["filter_expression"])), "|").alias("filters"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority <> 'zzz' THEN o_orderpriority END AS value, data_id FROM orders JOIN (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) + 2 AS data_id FROM (SELECT DISTINCT o_orderpriority FROM orders)) USING (o_orderpriority) UNION ALL SELECT o_orderkey, NULL, -1 FROM orders WHERE o_orderkey % 100 = 0".replace("UNION ALL SELECT o_orderkey, NULL, -1", "UNION ALL SELECT -o_orderkey, NULL, -1"))
def dictionary_decode(table, spark):
    """Priorities to ids and back; an id that the dictionary doesn't have gives null."""
    orders = table("orders")
    words = rel.dictionary(orders, "o_orderpriority", least=3)
    ids = orders.join(words, orders["o_orderpriority"] == words["value"]).select("o_orderkey", F.col("data_id").alias("id"))
    missing = orders.filter("o_orderkey % 100 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit(-1).cast("long").alias("id"))
    return rel.decode(ids.unionByName(missing), words, "id").select("o_orderkey", "value", F.col("id").alias("data_id"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_keys_anti(table, spark):
    """Documents without a rating."""
    return rel.orphans(table("documents").select("doc_id", "lang", "source"), table("labels"), "doc_id")
