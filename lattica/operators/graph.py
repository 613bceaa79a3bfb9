"""A model's relationship graph as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattica.functions import text as tx
from lattica.operators import catalog


def nodes(model: catalog.Model, show_hidden: bool = False) -> DataFrame:
    """Visible tables with their numbers of columns and measures."""
    counted = catalog.visible(catalog.table_counts(model), show_hidden)
    return counted.select("model_id", F.col("name").alias("id"), F.col("name").alias("label"), "type", "column_count", "measure_count", "is_hidden")


def edges(model: catalog.Model, show_hidden: bool = False) -> DataFrame:
    """Relationships between visible tables, drawn from the one side to the many side."""
    seen = catalog.visible(model.tables, show_hidden).select("model_id", F.col("name"))
    kept = model.relationships
    for side in ("from_table", "to_table"):
        kept = kept.join(seen.withColumnRenamed("name", side), ["model_id", side], "left_semi")
    label = tx.cardinality_label("cardinality")
    return kept.select(
        "model_id",
        F.concat_ws("_", "from_table", "from_column", "to_table", "to_column").alias("id"),
        F.col("to_table").alias("source"),
        F.col("from_table").alias("target"),
        F.concat(F.col("to_column"), F.lit(" → "), F.col("from_column"), F.lit(" ("), label, F.lit(")")).alias("label"),
        label.alias("cardinality"),
        F.col("cross_filter_direction").alias("direction"),
        "is_active",
    )


def elements(model: catalog.Model, show_hidden: bool = False) -> DataFrame:
    """Nodes and edges in one table."""
    a = nodes(model, show_hidden).withColumn("kind", F.lit("nodes"))
    return a.unionByName(edges(model, show_hidden).withColumn("kind", F.lit("edges")), allowMissingColumns=True)


def edge_style() -> F.Column:
    """The class an edge is drawn with; what applies later wins."""
    return F.when(~F.col("is_active"), "inactive").when(F.col("direction") == "both", "both").otherwise("plain")


def node_style() -> F.Column:
    kind = F.when(F.col("type").isin("directQuery", "calculated", "dual"), F.col("type")).otherwise("import")
    return F.concat(kind, F.when(F.col("is_hidden"), " hidden").otherwise(""))
