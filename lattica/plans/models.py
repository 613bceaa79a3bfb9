"""Search, selection, grouping and the graph over a model of the driver's own tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import catalog, graph
from lattica.operators import relational as rel
from lattica.plans.registry import query

# The model of the driver's tables: fixed values.
TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "H$orders", "LocalDateTable_1")
HIDDEN = ("labels", "H$orders", "LocalDateTable_1")
KINDS = {"events": "directQuery", "labels": "dual", "H$orders": "calculated"}
RELATIONSHIPS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey", "manyToOne", "single", True),
    ("lineitem", "l_partkey", "part", "p_partkey", "manyToOne", "single", True),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey", "manyToOne", "both", True),
    ("orders", "o_custkey", "customer", "c_custkey", "manyToOne", "single", True),
    ("customer", "c_nationkey", "nation", "n_nationkey", "manyToOne", "single", True),
    ("supplier", "s_nationkey", "nation", "n_nationkey", "manyToOne", "single", False),
    ("nation", "n_regionkey", "region", "r_regionkey", "manyToOne", "single", True),
    ("labels", "doc_id", "documents", "doc_id", "oneToOne", "both", True),
    ("orders", "o_custkey", "customer", "c_custkey", "manyToOne", "single", False),
)
MEASURES = (
    ("orders", "Total Price", "SUM(orders[o_totalprice])", "Revenue", False),
    ("orders", "Order Count", "COUNTROWS(orders)", "", False),
    ("lineitem", "Revenue", "SUMX(lineitem, lineitem[l_extendedprice] * (1 - lineitem[l_discount]))", "Revenue", False),
    ("lineitem", "Quantity", "SUM(lineitem[l_quantity])", "", False),
    ("customer", "Customers", "COUNTROWS(customer)", "Counts", False),
    ("customer", "Helper", "BLANK()", "Counts", True),
    ("events", "Event:Count", "COUNTROWS(events)", "", False),
)
ROLES = (("Europe", "region", "[r_name] = \"EUROPE\""), ("Europe", "nation", ""), ("Reader", None, None))
DATA_TYPES = {"int": "int64", "bigint": "int64", "double": "double", "string": "string", "timestamp_ntz": "dateTime", "timestamp": "dateTime"}


def driver_model(table, spark) -> catalog.Model:
    """The model, its columns from the files' schemas."""
    columns = []
    for name in TABLES:
        if name in HIDDEN[1:]:
            continue
        for k, (c, kind) in enumerate(table(name).dtypes):
            columns.append(("m", name, k, c, DATA_TYPES.get(kind, "string"), "data", c.endswith("key"), None, "", None, "", ""))
    return catalog.model_of(
        spark,
        {
            "models": [("m", "Driver", 1604, "en-US", "bim")],
            "tables": [("m", k, t, KINDS.get(t, "import"), t in HIDDEN, "") for k, t in enumerate(TABLES)],
            "columns": columns,
            "measures": [("m", t, k, n, e, "", f, "", h) for k, (t, n, e, f, h) in enumerate(MEASURES)],
            "relationships": [("m", k, *r) for k, r in enumerate(RELATIONSHIPS)],
            "role_permissions": [("m", r, k, t, f) for k, (r, t, f) in enumerate(ROLES)],
        },
    )


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + ")"


_T = _values("t", "ord, name, type, is_hidden", [(k, t, KINDS.get(t, "import"), t in HIDDEN) for k, t in enumerate(TABLES)])
_M = _values("m", "ord, tbl, name, expression, folder, is_hidden", [(k, *r) for k, r in enumerate(MEASURES)])
_R = _values("r", "ord, ft, fc, tt, tc, card, dir, active", [(k, *r) for k, r in enumerate(RELATIONSHIPS)])
_P = _values("p", "role, tbl, filter", ROLES)
# the files' own schemas
_C = "c(tbl, name) AS (SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN (" + ", ".join(_value(t) for t in TABLES) + "))"
_LABEL = "CASE card WHEN 'manyToOne' THEN '*:1' WHEN 'oneToMany' THEN '1:*' WHEN 'oneToOne' THEN '1:1' ELSE '*:*' END"
_RKEY = "'rel:' || ft || ':' || fc || ':' || tt || ':' || tc"


@query(f"WITH {_T}, {_M}, {_C} SELECT name FROM t WHERE NOT is_hidden AND (contains(lower(name), 'key') OR EXISTS (SELECT 1 FROM c WHERE tbl = t.name AND contains(lower(c.name), 'key')) OR EXISTS (SELECT 1 FROM m WHERE tbl = t.name AND (contains(lower(m.name), 'key') OR contains(lower(expression), 'key')))) UNION ALL SELECT cast(doc_id AS VARCHAR) FROM documents WHERE contains(lower(text), 'tion')")
def search_tables(table, spark):
    """Tables that a text is found in; and the same predicate over whole texts."""
    found = catalog.search_tables(driver_model(table, spark), "KEY").select("name")
    return found.unionByName(table("documents").filter(F.contains(F.lower("text"), F.lit("tion"))).select(F.col("doc_id").cast("string").alias("name")))


@query(f"WITH {_M} SELECT tbl AS \"table\", name FROM m WHERE NOT is_hidden AND (contains(lower(name), 'count') OR contains(lower(expression), 'count') OR contains(lower(tbl), 'count')) UNION ALL SELECT p_brand, p_name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'steel')")
def search_measures(table, spark):
    """Measures by name, expression or table; and the same over parts."""
    found = catalog.search_measures(driver_model(table, spark), "Count").select("table", "name")
    parts = table("part").filter(F.contains(F.lower("p_name"), F.lit("a")) | F.contains(F.lower("p_type"), F.lit("steel")))
    return found.unionByName(parts.select(F.col("p_brand").alias("table"), F.col("p_name").alias("name")))


@query(f"WITH {_R} SELECT ord, ft AS from_table, tt AS to_table FROM r WHERE contains(lower(ft), 'nation') OR contains(lower(tt), 'nation')")
def search_relationships(table, spark):
    return catalog.search_relationships(driver_model(table, spark), "nation").select("ord", "from_table", "to_table")


@query("SELECT page_id, CASE WHEN contains(lower(url), 'en') THEN 1.0 ELSE 0.15 END::DOUBLE AS opacity FROM pages".replace("CASE", "cast(CASE").replace("END::DOUBLE", "END AS DOUBLE)"))
def search_highlight(table, spark):
    """Opacity by whether a url holds a text."""
    return table("pages").select("page_id", catalog.opacity("url", "EN").alias("opacity"))


_KEYS = f"SELECT 'table:' || name AS key FROM t UNION ALL SELECT 'measure:' || tbl || ':' || name FROM m UNION ALL SELECT {_RKEY} FROM r UNION ALL SELECT 'role:' || role FROM p"


@query(f"WITH {_T}, {_R} SELECT ord, 'table:' || name AS key FROM t UNION ALL SELECT 100 + ord, {_RKEY} FROM r")
def object_keys(table, spark):
    """Keys of tables and relationships; two relationships with the same ends share one."""
    model = driver_model(table, spark)
    return model.tables.select("ord", tx.object_key("table", "name").alias("key")).unionByName(model.relationships.select((F.col("ord") + 100).alias("ord"), catalog.relationship_key().alias("key")))


@query(f"WITH {_M} SELECT name, expression FROM m WHERE 'measure:' || tbl || ':' || name = 'measure:events:Event:Count' UNION ALL SELECT c_name, c_mktsegment FROM customer WHERE 'customer:' || c_custkey = 'customer:7'")
def point_lookup(table, spark):
    """Objects by key; a name may hold a colon."""
    own = catalog.lookup(driver_model(table, spark).measures, tx.object_key("measure", "table", "name"), "measure:events:Event:Count").select("name", "expression")
    customer = catalog.lookup(table("customer"), tx.object_key("customer", F.col("c_custkey").cast("string")), "customer:7")
    return own.unionByName(customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("expression")))


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_size > 25)")
def hidden_filter(table, spark):
    """Rows that aren't hidden; large parts count as hidden."""
    return catalog.visible(table("part").withColumn("is_hidden", F.col("p_size") > 25)).select("p_partkey", "p_name")


_MARKED = "CASE c_custkey % 7 WHEN 0 THEN 'LocalDateTable_' WHEN 1 THEN 'H$' WHEN 2 THEN 'R$' WHEN 3 THEN 'U$' WHEN 4 THEN 'DateTableTemplate_' ELSE '' END || c_name"


@query(f"WITH {_T} SELECT name FROM t WHERE NOT (starts_with(name, 'LocalDateTable_') OR starts_with(name, 'H$')) UNION ALL SELECT c_name FROM customer WHERE c_custkey % 7 > 4")
def prefix_exclusion(table, spark):
    """Names without the store's own prefixes."""
    model = driver_model(table, spark)
    marks = F.element_at(F.array(*map(F.lit, ("LocalDateTable_", "H$", "R$", "U$", "DateTableTemplate_", "", ""))), (F.col("c_custkey") % 7 + 1).cast("int"))
    names = table("customer").select(F.concat(marks, F.col("c_name")).alias("name"))
    return model.tables.select("name").unionByName(names).filter(~catalog.is_internal("name"))


@query("SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def default_fill(table, spark):
    """Defaults where a left join leaves nulls."""
    joined = table("documents").select("doc_id").join(table("labels"), "doc_id", "left")
    return catalog.with_defaults(joined, {"quality": 0, "toxic": -1})


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber IN (1, 2)")
def physical_columns_only(table, spark):
    """Columns of type 1 and 2 only: line numbers stand for types."""
    return table("lineitem").filter(F.col("l_linenumber").isin(1, 2)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def first_match_per_group(table, spark):
    """Each customer's first order."""
    return rel.first_by(table("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderkey")


@query(f"WITH {_T}, {_M}, {_R}, {_P} SELECT (SELECT count(*) FROM t) AS tables, (SELECT count(*) FROM m) AS measures, (SELECT count(*) FROM r) AS relationships, (SELECT count(DISTINCT role) FROM p) AS roles")
def model_counts(table, spark):
    return catalog.counts(driver_model(table, spark)).drop("model_id")


@query(f"WITH {_T}, {_M}, {_C} SELECT name, c AS column_count, m AS measure_count, c || 'c' || CASE WHEN m > 0 THEN ' ' || m || 'm' ELSE '' END AS note FROM (SELECT name, (SELECT count(*) FROM c WHERE tbl = t.name) AS c, (SELECT count(*) FROM m WHERE tbl = t.name) AS m FROM t)")
def per_table_counts(table, spark):
    return catalog.table_counts(driver_model(table, spark)).select("name", "column_count", "measure_count", "note")


@query("SELECT p_brand, folder AS p_type, string_agg(p_name, '|' ORDER BY p_partkey) AS names FROM (SELECT p_brand, p_name, p_partkey, CASE WHEN p_size % 4 = 0 THEN '(no folder)' ELSE p_type END AS folder FROM part) GROUP BY ALL")
def group_by_folder(table, spark):
    """Names by folder, a quarter of which are blanked first."""
    blanked = table("part").withColumn("p_type", F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.col("p_type")))
    return catalog.by_folder(blanked, "p_type", ["p_brand"], "p_name", "p_partkey").withColumn("names", F.array_join("names", "|"))


@query("SELECT p_brand, string_agg(p_name, '|' ORDER BY p_partkey) AS names FROM part GROUP BY p_brand")
def group_collect(table, spark):
    return catalog.collected(table("part"), ["p_brand"], "p_name", "p_partkey").withColumn("names", F.array_join("names", "|"))


@query(f"WITH {_T}, {_M}, {_R}, {_P}, k AS ({_KEYS}) SELECT DISTINCT key FROM k UNION ALL (SELECT 'customer:' || c_custkey FROM customer UNION SELECT 'customer:' || o_custkey FROM orders)")
def union_all_keys(table, spark):
    """Every key once; and the distinct union of the keys of two tables."""
    own = catalog.keys(driver_model(table, spark)).select("key")
    customers = table("customer").select(tx.object_key("customer", F.col("c_custkey").cast("string")).alias("key"))
    orders = table("orders").select(tx.object_key("customer", F.col("o_custkey").cast("string")).alias("key"))
    return own.unionByName(customers.unionByName(orders).distinct())


@query(f"WITH {_T}, {_M}, {_R}, {_P}, k AS ({_KEYS}) SELECT DISTINCT key FROM k WHERE key <> 'table:orders' UNION ALL (SELECT 'customer:' || c_custkey FROM customer EXCEPT SELECT 'customer:' || o_custkey FROM orders)")
def key_set_except(table, spark):
    """Keys less one that is unchecked; and customers less those with orders."""
    one = spark.createDataFrame([("table:orders",)], "key string")
    own = catalog.keys(driver_model(table, spark)).select("key").exceptAll(one)
    customers = table("customer").select(tx.object_key("customer", F.col("c_custkey").cast("string")).alias("key"))
    orders = table("orders").select(tx.object_key("customer", F.col("o_custkey").cast("string")).alias("key")).distinct()
    return own.unionByName(customers.exceptAll(orders))


@query(f"WITH {_R} SELECT ord, ft AS from_table, tt AS to_table FROM r WHERE {_RKEY} IN ('rel:orders:o_custkey:customer:c_custkey', 'rel:nation:n_regionkey:region:r_regionkey') UNION ALL SELECT cast(o_orderkey AS INTEGER) + 1000, o_orderpriority, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def select_semi_join(table, spark):
    """Objects whose keys are chosen, both relationships that share a key among them; and orders of some customers."""
    chosen = spark.createDataFrame([("rel:orders:o_custkey:customer:c_custkey",), ("rel:nation:n_regionkey:region:r_regionkey",), ("table:none",)], "key string")
    own = catalog.selected(driver_model(table, spark), chosen).relationships.select("ord", "from_table", "to_table")
    some = table("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table("orders").join(some, "o_custkey", "left_semi").select((F.col("o_orderkey").cast("int") + 1000).alias("ord"), F.col("o_orderpriority").alias("from_table"), F.col("o_orderstatus").alias("to_table"))
    return own.unionByName(orders)


_SEEN = "SELECT * FROM r WHERE ft IN (SELECT name FROM t WHERE NOT is_hidden) AND tt IN (SELECT name FROM t WHERE NOT is_hidden)"
_EDGES = f"SELECT ft || '_' || fc || '_' || tt || '_' || tc AS id, tt AS source, ft AS target, tc || ' → ' || fc || ' (' || {_LABEL} || ')' AS label, {_LABEL} AS cardinality, dir AS direction, active AS is_active FROM ({_SEEN})"
_NODES = "SELECT name AS id, name AS label, type, (SELECT count(*) FROM c WHERE tbl = t.name) AS column_count, (SELECT count(*) FROM m WHERE tbl = t.name) AS measure_count, is_hidden FROM t WHERE NOT is_hidden"


@query(f"WITH {_T}, {_R} SELECT ft AS from_table, tt AS to_table, count(*) AS n FROM ({_SEEN}) GROUP BY ALL")
def edges_visible(table, spark):
    """Relationships both of whose tables are seen."""
    return graph.edges(driver_model(table, spark)).groupBy(F.col("target").alias("from_table"), F.col("source").alias("to_table")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_T}, {_M}, {_C} {_NODES}")
def diagram_nodes(table, spark):
    return graph.nodes(driver_model(table, spark)).drop("model_id")


@query(f"WITH {_T}, {_R} {_EDGES}")
def diagram_edges(table, spark):
    return graph.edges(driver_model(table, spark)).drop("model_id")


@query(f"WITH {_T}, {_M}, {_R}, {_C} SELECT 'nodes' AS kind, id, label, type, NULL AS source FROM ({_NODES}) UNION ALL SELECT 'edges', id, label, NULL, source FROM ({_EDGES})")
def diagram_elements(table, spark):
    return graph.elements(driver_model(table, spark)).select("kind", "id", "label", "type", "source")


@query(f"WITH {_T}, {_R} SELECT id, CASE WHEN NOT is_active THEN 'inactive' WHEN direction = 'both' THEN 'both' ELSE 'plain' END AS style FROM ({_EDGES}) UNION ALL SELECT name, CASE WHEN type IN ('directQuery', 'calculated', 'dual') THEN type ELSE 'import' END || CASE WHEN is_hidden THEN ' hidden' ELSE '' END FROM t")
def edge_style_class(table, spark):
    """How edges and nodes are drawn."""
    model = driver_model(table, spark)
    drawn = graph.edges(model).select("id", graph.edge_style().alias("style"))
    return drawn.unionByName(graph.nodes(model, show_hidden=True).select("id", graph.node_style().alias("style")))


_COUNTED = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in TABLES[:7])


@query(f"WITH {_T}, n AS ({_COUNTED}) SELECT t.name, type, row_count FROM t LEFT JOIN n USING (name)")
def tables_with_profile(table, spark):
    """Tables beside their profile, where there is one."""
    from functools import reduce

    from lattica.operators import profile as pf

    told = reduce(lambda a, b: a.unionByName(b), (pf.ranges(table(t)).filter("ord = 0").select(F.lit(t).alias("name"), "row_count") for t in TABLES[:7]))
    return driver_model(table, spark).tables.join(told, "name", "left").select("name", "type", "row_count")
