"""Column profiles of the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import profile as pf
from lattica.operators import relational as rel
from lattica.plans.registry import query

# Columns of the star tables by what a profile says of them: fixed values for the SQL side.
NUMBERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"],
}
TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "supplier": ["s_name"], "customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
}
DATES = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}


def _number_sql(table: str, column: str, name: str) -> str:
    x = f"CASE WHEN isfinite(cast({column} AS DOUBLE)) THEN cast({column} AS DOUBLE) END"
    return (
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, count(*) AS row_count, count(*) - count({column}) AS nulls, count(DISTINCT {column}) AS \"distinct\", "
        f"min({x}) AS num_min, max({x}) AS num_max, floor(avg({x}) * 100 + 0.5) / 100 AS num_avg FROM {table}"
    )


def _join(parts) -> str:
    return " UNION ALL ".join(parts)


NUMERIC_COLUMNS = ["table_name", "column_name", "row_count", "nulls", "distinct", "num_min", "num_max", "num_avg"]


@query(_join(_number_sql("lineitem", c, "lineitem") for c in NUMBERS["lineitem"]))
def profile_numeric(table, spark):
    """Counts, ranges and averages of lineitem's numbers."""
    told = pf.profile(table("lineitem"), columns=NUMBERS["lineitem"])
    return told.select(F.lit("lineitem").alias("table_name"), *NUMERIC_COLUMNS[1:])


def _labelled(table):
    return table("documents").join(table("labels"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


_LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(_join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS nulls FROM {_LABELLED}" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def profile_nulls(table, spark):
    """Null counts where a left join leaves some."""
    return pf.ranges(_labelled(table)).select("column_name", "row_count", "nulls")


_DISTINCT = {"orders": NUMBERS["orders"] + TEXTS["orders"] + DATES["orders"], "events": NUMBERS["events"] + TEXTS["events"] + DATES["events"]}


@query(_join([f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS \"distinct\" FROM {t}" for t, cs in _DISTINCT.items() for c in cs] + [f"SELECT 'labelled' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS \"distinct\" FROM {_LABELLED}" for c in ("quality", "toxic", "lang")]))
def profile_distinct(table, spark):
    """Exact distinct counts; null isn't a value."""
    parts = [pf.distinct(table(t).select(*cs)).select(F.lit(t).alias("table_name"), "column_name", "distinct") for t, cs in _DISTINCT.items()]
    labelled = pf.distinct(_labelled(table).select("quality", "toxic", "lang")).select(F.lit("labelled").alias("table_name"), "column_name", "distinct")
    return parts[0].unionByName(parts[1]).unionByName(labelled)


@query(_join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, min({c}) AS date_min, max({c}) AS date_max FROM {t}" for t, cs in DATES.items() for c in cs))
def profile_dates(table, spark):
    """First and last dates."""
    parts = [pf.ranges(table(t).select(*cs)).select(F.lit(t).alias("table_name"), "column_name", "date_min", "date_max") for t, cs in DATES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _top_sql(table: str, column: str, position: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, string_agg(v || ' (' || format('{{:,}}', n) || ')', ', ' ORDER BY r) AS top "
        f"FROM (SELECT v, n, row_number() OVER (ORDER BY n DESC, p, v) AS r, count(*) OVER () AS k FROM (SELECT {column} AS v, count(*) AS n, min({position}) AS p FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)) WHERE r <= 5 AND k <= 1000"
    )


_TOP = (("orders", "o_orderstatus", "o_orderkey"), ("orders", "o_orderpriority", "o_orderkey"), ("events", "event_type", "event_id"), ("customer", "c_mktsegment", "c_custkey"), ("customer", "c_name", "c_custkey"), ("part", "p_brand", "p_partkey"))


@query(_join(_top_sql(*x) for x in _TOP))
def profile_top_values(table, spark):
    """The five most frequent values, ties by first appearance, where there are at most 1,000 distinct ones."""
    keys = {t: k for t, _, k in _TOP}
    parts = [pf.profile(table(t), F.col(keys[t]), [c for u, c, _ in _TOP if u == t]).select(F.lit(t).alias("table_name"), "column_name", pf.top_text().alias("top")) for t in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    _join(
        [f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM {t}" for t in NUMBERS for c in NUMBERS[t] + TEXTS[t] + DATES.get(t, [])]
    )
)
def profile_all_tables(table, spark):
    """Every column of every star table in one long table."""
    return pf.profile_tables({t: (table(t), None) for t in NUMBERS}).select("table_name", "column_name", "row_count", "nulls", "distinct")


_STAT = "CASE WHEN abs(v) >= 1e6 THEN regexp_replace(printf('%.2e', v), 'e([+-])0?([0-9])', 'e\\1\\2') WHEN v = floor(v) THEN format('{:,}', cast(v AS BIGINT)) ELSE regexp_replace(regexp_replace(format('{:,.2f}', v), '0$', ''), '\\.0$', '') END"


@query(
    f"SELECT column_name, {_STAT.replace('v', 'num_min')} AS low, {_STAT.replace('v', 'num_max')} AS high FROM ("
    + _join(f"SELECT '{c}' AS column_name, cast(min({c}) AS DOUBLE) AS num_min, cast(max({c}) AS DOUBLE) AS num_max FROM orders" for c in NUMBERS["orders"])
    + " UNION ALL SELECT 'total', sum(o_custkey)::DOUBLE, sum(o_orderkey)::DOUBLE FROM orders)".replace("sum(o_custkey)", "cast(sum(o_custkey) AS DOUBLE)").replace("::DOUBLE", "")
)
def format_stat(table, spark):
    """Ranges as a report shows them."""
    ranges = pf.ranges(table("orders").select(*NUMBERS["orders"])).select("column_name", "num_min", "num_max")
    total = table("orders").agg(F.sum("o_custkey").cast("double").alias("num_min"), F.sum("o_orderkey").cast("double").alias("num_max")).select(F.lit("total").alias("column_name"), "num_min", "num_max")
    return ranges.unionByName(total).select("column_name", tx.format_stat("num_min").alias("low"), tx.format_stat("num_max").alias("high"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_100(table, spark):
    """The first 100 rows and how many there are: the preview is the feature."""
    orders = table("orders")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    return rel.row_slice(orders, ["o_orderkey"], 0, 100).select("o_orderkey", "o_custkey", "o_totalprice").crossJoin(F.broadcast(total))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 250")
def row_slice(table, spark):
    """Rows 250 to 289 by key: the slice is the feature."""
    return rel.row_slice(table("orders"), ["o_orderkey"], 250, 40).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT t AS table_name, max(n) AS row_count FROM (SELECT 'orders' AS t, count(o_orderkey) AS n FROM orders UNION ALL SELECT 'orders', count(CASE WHEN o_orderstatus = 'F' THEN 1 END) FROM orders UNION ALL SELECT 'labels', count(doc_id) FROM labels UNION ALL SELECT 'labels', count(CASE WHEN toxic = 1 THEN 1 END) FROM labels) GROUP BY t")
def ragged_row_count(table, spark):
    """A table's rows are its longest column's."""
    sizes = table("orders").agg(F.count("o_orderkey").alias("a"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("b")).select(F.lit("orders").alias("table_name"), F.explode(F.array("a", "b")).alias("n"))
    more = table("labels").agg(F.count("doc_id").alias("a"), F.count(F.when(F.col("toxic") == 1, 1)).alias("b")).select(F.lit("labels").alias("table_name"), F.explode(F.array("a", "b")).alias("n"))
    return rel.ragged_length(sizes.unionByName(more), "n", ["table_name"])
