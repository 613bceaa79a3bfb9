"""Exports and reports; what is written is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import markdown, sinks
from lattica.operators import profile as pf
from lattica.plans import models
from lattica.plans.registry import query
from lattica.sources import folders


_CSV = "CASE WHEN regexp_matches(props, '[,\"\\n\\r]') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END"


def _shortest(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e15 AND {x} = floor({x}) THEN cast(cast({x} AS BIGINT) AS VARCHAR) ELSE cast({x} AS VARCHAR) END"


@query(f"SELECT event_id || ',' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ',' || event_type || ',' || {_shortest('value')} || ',' || {_shortest('cast(event_id % 9 + 1 AS DOUBLE) * 1e21')} || ',' || {_shortest('floor(value) * 1e5')} || ',' || {_CSV} AS line FROM events")
def csv_lines(table, spark):
    """Events as lines of a CSV file, with numbers beyond what is written without exponent, and whole ones."""
    more = (((F.col("event_id") % 9 + 1).cast("double") * 1e21).alias("large"), (F.floor("value").cast("double") * 1e5).alias("whole"))
    return sinks.csv_lines(table("events").select("event_id", "ts", "event_type", "value", *more, "props"))


@query("SELECT doc_id, text, lang, source FROM documents")
def csv_roundtrip(table, spark):
    """Texts with quotes, commas and line breaks, written as CSV and read again."""
    docs, path = table("documents").select("doc_id", "text", "lang", "source"), folders.shared(spark)
    sinks.write_csv(docs, path)
    return sinks.read_csv(spark, path, docs.schema)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def parquet_roundtrip(table, spark):
    """Orders written as Parquet and read again."""
    orders, path = table("orders"), folders.shared(spark)
    sinks.write_parquet(orders, path)
    return spark.read.schema(orders.schema).parquet(path)


def _markdown_sql() -> str:
    grouped = lambda x: f"format('{{:,}}', cast({x} AS BIGINT))"
    parts = ["SELECT 0 AS section, '# Model: Driver' AS line", f"SELECT 0, 'Compatibility Level: 1604 | Tables: {len(models.TABLES)} | Measures: {len(models.MEASURES)} | Relationships: {len(models.RELATIONSHIPS)}'"]
    parts.append("SELECT 1, '## Tables'")
    parts.append("SELECT 1, '### ' || name || CASE WHEN type <> 'import' THEN ' [' || type || ']' ELSE '' END FROM t")
    parts.append("SELECT 1, unnest(['| Column | Type | Hidden | Calculated | Format |', '|--------|------|:------:|:----------:|--------|']) FROM (SELECT DISTINCT tbl FROM c)")
    kind = "CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'int64' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type LIKE 'TIMESTAMP%' THEN 'dateTime' ELSE 'string' END"
    hidden = "CASE WHEN ends_with(name, 'key') THEN 'Yes' ELSE '' END"
    parts.append(f"SELECT 1, '| ' || name || ' | ' || {kind} || ' | ' || {hidden} || ' |  |  |' FROM c")
    parts.append(f"SELECT 1, '**Data profile** (' || {grouped('count(*)')} || ' rows):' FROM region UNION ALL SELECT 1, '**Data profile** (' || {grouped('count(*)')} || ' rows):' FROM nation")
    parts.append("SELECT 1, '- **r_regionkey** -- ' || count(DISTINCT r_regionkey) || ' distinct, 0 nulls, avg: ' || cast(avg(r_regionkey) AS BIGINT) || ', range: ' || min(r_regionkey) || ' .. ' || max(r_regionkey) FROM region")
    parts.append("SELECT 1, '- **r_name** -- ' || count(DISTINCT r_name) || ' distinct, 0 nulls, top: ' || string_agg(r_name || ' (1)', ', ' ORDER BY r_regionkey) FROM region")
    for c in ("n_nationkey", "n_regionkey"):
        mean = f"regexp_replace(regexp_replace(format('{{:,.2f}}', floor(avg({c}) * 100 + 0.5) / 100), '0$', ''), '\\.0$', '')"
        parts.append(f"SELECT 1, '- **{c}** -- ' || count(DISTINCT {c}) || ' distinct, 0 nulls, avg: ' || {mean} || ', range: ' || min({c}) || ' .. ' || max({c}) FROM nation")
    parts.append("SELECT 1, '- **n_name** -- ' || count(DISTINCT n_name) || ' distinct, 0 nulls, top: ' || string_agg(n_name || ' (1)', ', ' ORDER BY n_nationkey) FILTER (n_nationkey < 5) FROM nation")
    parts.append("SELECT 2, '## Measures' UNION ALL SELECT 2, '### Table: ' || tbl FROM (SELECT DISTINCT tbl FROM m)")
    parts.append("SELECT 2, unnest(['**' || name || '**', '```dax', expression, '```']) FROM m")
    parts.append("SELECT 4, unnest(['## Relationships', '| From | To | Cardinality | Direction | Active |', '|------|-----|:-----------:|:---------:|:------:|'])")
    parts.append(f"SELECT 4, '| ' || ft || '[' || fc || '] | ' || tt || '[' || tc || '] | ' || {models._LABEL} || ' | ' || CASE dir WHEN 'both' THEN 'Both' ELSE 'Single' END || ' | ' || CASE WHEN active THEN 'Yes' ELSE 'No' END || ' |' FROM r")
    parts.append("SELECT 5, '## Roles' UNION ALL SELECT 5, '**' || role || '**' FROM (SELECT DISTINCT role FROM p) UNION ALL SELECT 5, '- ' || tbl || ': `' || filter || '`' FROM p WHERE filter <> ''")
    columns = models._C.replace("c(tbl, name) AS (SELECT table_name, column_name", "c(tbl, name, data_type) AS (SELECT table_name, column_name, data_type")
    return f"WITH {models._T}, {models._M}, {models._R}, {models._P}, {columns} " + " UNION ALL ".join(parts)


@query(_markdown_sql())
def markdown_lines(table, spark):
    """The report of the driver's tables, two of them with their profile; blank lines are left out, as rows have no order."""
    stats = pf.profile_tables({t: (table(t), F.col(k)) for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"))})
    return markdown.report(models.driver_model(table, spark), stats=stats).filter("line <> ''").select("section", "line")


@query("SELECT conv_id, turn, '" + tx.PROMPTS["explain"].replace("'", "''").replace("\n", "") + "' || chr(10) || chr(10) || text AS prompt FROM conversations")
def prompt_prefix(table, spark):
    """Texts with an instruction in front."""
    return table("conversations").select("conv_id", "turn", tx.prompt("explain", "text").alias("prompt"))
