"""A semantic model as nine tables, and search, selection and grouping of its objects.

Every table has model_id, so many models can lie in one catalog, and ord, the source's order.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lattica.functions import text as tx

# Columns of the model's tables: fixed values.
SCHEMAS = {
    "models": "model_id string, name string, compatibility_level int, culture string, source_format string",
    "tables": "model_id string, ord int, name string, type string, is_hidden boolean, description string",
    "columns": "model_id string, table string, ord int, name string, data_type string, type string, is_hidden boolean, expression string, format_string string, sort_by_column string, display_folder string, description string",
    "measures": "model_id string, table string, ord int, name string, expression string, format_string string, display_folder string, description string, is_hidden boolean",
    "hierarchies": "model_id string, table string, ord int, name string, levels array<string>",
    "partitions": "model_id string, table string, ord int, type string, expression string, mode string",
    "calculation_items": "model_id string, table string, ord int, name string, expression string, ordinal int",
    "relationships": "model_id string, ord int, from_table string, from_column string, to_table string, to_column string, cardinality string, cross_filter_direction string, is_active boolean",
    "role_permissions": "model_id string, role string, ord int, table string, filter_expression string",
}
#: Name prefixes of a store's own tables.
INTERNAL = ("LocalDateTable_", "DateTableTemplate_", "H$", "R$", "U$")
NO_FOLDER = "(no folder)"


@dataclass
class Model:
    """The nine tables."""

    models: DataFrame
    tables: DataFrame
    columns: DataFrame
    measures: DataFrame
    hierarchies: DataFrame
    partitions: DataFrame
    calculation_items: DataFrame
    relationships: DataFrame
    role_permissions: DataFrame

    def union(self, other: Model) -> Model:
        """Both models' objects."""
        return Model(*(getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)))

    def register(self, prefix: str = "model_") -> None:
        """Temporary views of the tables."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(prefix + f.name)


def model_of(spark: SparkSession, rows: dict[str, list[tuple]]) -> Model:
    """A model of literal rows by table; tables that aren't given are empty. They are local relations, whose sizes the optimizer knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    def table(name: str) -> DataFrame:
        schema = to_arrow_schema(StructType.fromDDL(SCHEMAS[name]))
        listed = rows.get(name, [])
        columns = [pa.array([r[k] for r in listed], f.type) for k, f in enumerate(schema)]
        return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema), SCHEMAS[name])

    return Model(*(table(f.name) for f in fields(Model)))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls filled with defaults."""
    return df.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns))


def is_internal(name) -> Column:
    """Whether a name has one of the store's own prefixes."""
    return reduce(lambda a, b: a | b, (F.startswith(tx.col(name), F.lit(p)) for p in INTERNAL))


def visible(df: DataFrame, show_hidden: bool = False) -> DataFrame:
    return df if show_hidden else df.filter(~F.col("is_hidden"))


def _has(c, text: str) -> Column:
    return F.contains(F.lower(tx.col(c)), F.lit(text.lower()))


def search_tables(model: Model, text: str, show_hidden: bool = False) -> DataFrame:
    """Visible tables whose name, or a column's or measure's name or a measure's expression, holds the text, whatever the case."""
    tables = visible(model.tables, show_hidden)
    columns = model.columns.filter(_has("name", text)).select("model_id", F.col("table").alias("name"))
    measures = model.measures.filter(_has("name", text) | _has("expression", text)).select("model_id", F.col("table").alias("name"))
    own = tables.filter(_has("name", text)).select("model_id", "name")
    return tables.join(own.unionByName(columns).unionByName(measures), ["model_id", "name"], "left_semi")


def search_measures(model: Model, text: str, show_hidden: bool = False) -> DataFrame:
    return visible(model.measures, show_hidden).filter(_has("name", text) | _has("expression", text) | _has("table", text))


def search_relationships(model: Model, text: str) -> DataFrame:
    return model.relationships.filter(_has("from_table", text) | _has("to_table", text))


def search_roles(model: Model, text: str) -> DataFrame:
    return model.role_permissions.filter(_has("role", text)).select("model_id", "role").distinct()


def opacity(name, text: str) -> Column:
    """1 where a node's name holds the text, else 0.15."""
    return F.when(_has(name, text), 1.0).otherwise(0.15)


def relationship_key() -> Column:
    return tx.object_key("rel", "from_table", "from_column", "to_table", "to_column")


def keys(model: Model, show_hidden: bool = True) -> DataFrame:
    """(model_id, key) of everything that can be selected; relationships with the same ends share a key."""
    parts = [
        visible(model.tables, show_hidden).select("model_id", tx.object_key("table", "name").alias("key")),
        visible(model.measures, show_hidden).select("model_id", tx.object_key("measure", "table", "name").alias("key")),
        model.relationships.select("model_id", relationship_key().alias("key")),
        model.role_permissions.select("model_id", tx.object_key("role", "role").alias("key")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def lookup(df: DataFrame, key_column: Column, key: str) -> DataFrame:
    """The objects with a key; the key is compared whole, so names may hold colons."""
    return df.filter(key_column == F.lit(key))


def selected(model: Model, chosen: DataFrame) -> Model:
    """The model's tables, measures, relationships and roles whose keys are in chosen (key)."""
    keep = lambda df, key: df.withColumn("key", key).join(chosen.select("key"), "key", "left_semi").drop("key")
    return replace(
        model,
        tables=keep(model.tables, tx.object_key("table", "name")),
        measures=keep(model.measures, tx.object_key("measure", "table", "name")),
        relationships=keep(model.relationships, relationship_key()),
        role_permissions=keep(model.role_permissions, tx.object_key("role", "role")),
    )


def counts(model: Model) -> DataFrame:
    """(model_id, tables, measures, relationships, roles) of each model."""
    sides = [
        model.tables.groupBy("model_id").agg(F.count(F.lit(1)).alias("tables")),
        model.measures.groupBy("model_id").agg(F.count(F.lit(1)).alias("measures")),
        model.relationships.groupBy("model_id").agg(F.count(F.lit(1)).alias("relationships")),
        model.role_permissions.groupBy("model_id").agg(F.countDistinct("role").alias("roles")),
    ]
    out = reduce(lambda a, b: a.join(b, "model_id", "left"), sides, model.models.select("model_id"))
    return out.na.fill(0)


def table_counts(model: Model) -> DataFrame:
    """Tables with their numbers of columns and measures, and these as a short note."""
    per = lambda df, name: df.groupBy("model_id", F.col("table").alias("name")).agg(F.count(F.lit(1)).alias(name))
    out = model.tables.join(per(model.columns, "column_count"), ["model_id", "name"], "left").join(per(model.measures, "measure_count"), ["model_id", "name"], "left").na.fill(0, ["column_count", "measure_count"])
    note = F.concat(F.col("column_count"), F.lit("c"), F.when(F.col("measure_count") > 0, F.concat(F.lit(" "), F.col("measure_count"), F.lit("m"))).otherwise(""))
    return out.withColumn("note", note)


def by_folder(df: DataFrame, folder: str, group: list[str], name: str, order: str) -> DataFrame:
    """Names of each folder in order of `order`, an empty folder under a name of its own."""
    named = F.coalesce(F.nullif(F.col(folder), F.lit("")), F.lit(NO_FOLDER))
    return collected(df.withColumn(folder, named), [*group, folder], name, order)


def collected(df: DataFrame, group: list[str], name: str, order: str, out: str = "names") -> DataFrame:
    """The names of each group as an array in order of `order`; ties by name."""
    listed = F.array_sort(F.collect_list(F.struct(order, name)))
    return df.groupBy(*group).agg(F.transform(listed, lambda x: x[name]).alias(out))


def role_filters(roles: DataFrame, permissions: DataFrame, tables: DataFrame) -> DataFrame:
    """(role, filters) by joining roles (role_id, role) and permissions (role_id, table_id, filter_expression) with tables (table_id, name); roles without permissions are left out."""
    told = roles.join(permissions, "role_id").join(tables, "table_id")
    return told.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("name", "filter_expression"))).alias("filters"))


def resolve_relationships(relationships: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Names for relationships of ids (from_table_id, from_column_id, to_table_id, to_column_id): both tables must be there, columns need not."""
    t = lambda side: tables.select(F.col("table_id").alias(f"{side}_table_id"), F.col("name").alias(f"{side}_table"))
    c = lambda side: columns.select(F.col("column_id").alias(f"{side}_column_id"), F.col("name").alias(f"{side}_column"))
    out = relationships
    for side in ("from", "to"):
        out = out.join(t(side), f"{side}_table_id").join(c(side), f"{side}_column_id", "left")
    return out.drop("from_table_id", "from_column_id", "to_table_id", "to_column_id")


def first_m_source(model: Model) -> DataFrame:
    """Each table's first M partition that has a source."""
    own = model.partitions.filter("type = 'm' AND expression <> ''")
    rank = F.row_number().over(Window.partitionBy("model_id", "table").orderBy("ord"))
    return own.withColumn("rank", rank).filter("rank = 1").drop("rank")
