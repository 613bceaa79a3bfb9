"""A model's report as a table of lines, and the text they make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.functions import text as tx
from lattica.operators import catalog, profile as pf

#: Where a line stands: section, table, block of the table, object in the block, line of the object.
PLACE = ("section", "at_table", "block", "at_object", "at_line")


def _lines(df: DataFrame, section: int, at_table, block: int, at_object, *lines) -> DataFrame:
    """Rows as lines; null lines are left out but keep their number."""
    place = [F.lit(section), tx.col(at_table) if isinstance(at_table, str) else at_table, F.lit(block), tx.col(at_object) if isinstance(at_object, str) else at_object]
    told = df.select("model_id", *(p.cast("int").alias(n) for p, n in zip(place, PLACE)), F.posexplode(F.array(*(F.lit(x) if not isinstance(x, Column) else x for x in lines))).alias("at_line", "line"))
    return told.filter("line IS NOT NULL")


def _yes(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("")


def _fenced(title: Column, expression: Column, description: Column | None = None) -> list:
    return [title, *([description] if description is not None else []), F.lit("```dax"), F.coalesce(expression, F.lit("")), F.lit("```")]


def report(model: catalog.Model, chosen: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(model_id, section, at_table, block, at_object, at_line, line): all lines of the report, in the order of these columns.

    chosen (key) limits it to some objects; the numbers in the second line stay those of the whole model. stats are
    profile rows (table_name and profile()'s columns), shown under their tables. Sections without content are left out.
    """
    part = catalog.selected(model, chosen) if chosen is not None else model
    zero, last = F.lit(0), F.lit(1 << 30)
    cell = tx.md_escape
    heads = model.models.join(catalog.counts(model), "model_id")
    level = F.coalesce(F.nullif("compatibility_level", F.lit(0)).cast("string"), F.lit("N/A"))
    numbers = F.concat(F.lit("Compatibility Level: "), level, F.lit(" | Tables: "), "tables", F.lit(" | Measures: "), "measures", F.lit(" | Relationships: "), "relationships")
    out = [_lines(heads, 0, zero, 0, zero, F.concat(F.lit("# Model: "), "name"), numbers, "")]

    def section(number: int, df: DataFrame, *lines) -> None:
        out.append(_lines(df.select("model_id").distinct(), number, F.lit(-1), 0, zero, *lines))

    tables = part.tables.withColumnRenamed("ord", "at")
    names = tables.select("model_id", F.col("name").alias("table"), "at")
    badge = F.when(F.col("type") != "import", F.concat(F.lit(" ["), "type", F.lit("]"))).otherwise("")
    said = F.when(F.col("description") != "", F.concat(F.lit("> "), "description"))
    section(1, tables, "## Tables", "")
    out.append(_lines(tables, 1, "at", 0, zero, F.concat(F.lit("### "), "name", badge), said))
    columns = model.columns.join(names, ["model_id", "table"])
    out.append(_lines(columns.select("model_id", "at").distinct(), 1, "at", 1, F.lit(-1), "| Column | Type | Hidden | Calculated | Format |", "|--------|------|:------:|:----------:|--------|"))
    row = F.concat(F.lit("| "), cell("name"), F.lit(" | "), cell("data_type"), F.lit(" | "), _yes(F.col("is_hidden")), F.lit(" | "), _yes(F.col("type") == "calculated"), F.lit(" | "), cell("format_string"), F.lit(" |"))
    out.append(_lines(columns, 1, "at", 1, "ord", row))
    if stats is not None:
        told = names.join(stats.withColumnRenamed("table_name", "table"), "table")
        first = told.groupBy("model_id", "at").agg(F.min_by("row_count", "ord").alias("rows"))
        out.append(_lines(first, 1, "at", 2, F.lit(-1), "", F.concat(F.lit("**Data profile** ("), tx.format_grouped("rows"), F.lit(" rows):"))))
        out.append(_lines(told, 1, "at", 2, "ord", pf.bullet()))
    source = catalog.first_m_source(model).join(names, ["model_id", "table"])
    out.append(_lines(source, 1, "at", 3, zero, "", "Source (M):", "```", F.col("expression"), "```"))
    calculated = columns.filter("type = 'calculated' AND expression <> ''")
    out.append(_lines(calculated.select("model_id", "at").distinct(), 1, "at", 4, F.lit(-1), ""))
    out.append(_lines(calculated, 1, "at", 4, "ord", *_fenced(F.concat(F.lit("**"), "table", F.lit("["), "name", F.lit("]** (calculated column)")), F.col("expression"))))
    out.append(_lines(tables, 1, "at", 5, zero, ""))

    everywhere = model.tables.select("model_id", F.col("name").alias("table"), F.col("ord").alias("at"))
    measures = part.measures.join(everywhere, ["model_id", "table"])
    section(2, measures, "## Measures", "")
    out.append(_lines(measures.select("model_id", "at", "table").distinct(), 2, "at", 0, F.lit(-1), F.concat(F.lit("### Table: "), "table"), ""))
    shown = F.when(F.col("format_string") != "", F.concat(F.lit(" | Format: "), "format_string")).otherwise("")
    out.append(_lines(measures, 2, "at", 0, "ord", *_fenced(F.concat(F.lit("**"), "name", F.lit("**"), shown), F.col("expression"), said), ""))

    items = model.calculation_items.join(names, ["model_id", "table"])
    section(3, items, "## Calculation Groups", "")
    out.append(_lines(items.select("model_id", "at", "table").distinct(), 3, "at", 0, F.lit(-1), F.concat(F.lit("### "), "table")))
    out.append(_lines(items, 3, "at", 0, "ord", *_fenced(F.concat(F.lit("**"), "name", F.lit("**")), F.col("expression")), ""))

    relations = part.relationships
    section(4, relations, "## Relationships", "| From | To | Cardinality | Direction | Active |", "|------|-----|:-----------:|:---------:|:------:|")
    end = lambda t, c: F.concat(cell(t), F.lit("["), cell(c), F.lit("]"))
    both = F.when(F.col("cross_filter_direction") == "both", "Both").otherwise("Single")
    row = F.concat(F.lit("| "), end("from_table", "from_column"), F.lit(" | "), end("to_table", "to_column"), F.lit(" | "), tx.cardinality_label("cardinality"), F.lit(" | "), both, F.lit(" | "), F.when(F.col("is_active"), "Yes").otherwise("No"), F.lit(" |"))
    out.append(_lines(relations, 4, zero, 0, "ord", row))
    out.append(_lines(relations.select("model_id").distinct(), 4, last, 0, zero, ""))

    permissions = part.role_permissions
    first = permissions.groupBy("model_id", "role").agg(F.min("ord").alias("at"))
    section(5, permissions, "## Roles", "")
    out.append(_lines(first, 5, "at", 0, F.lit(-1), F.concat(F.lit("**"), "role", F.lit("**"))))
    filters = permissions.filter("filter_expression <> ''").join(first, ["model_id", "role"])
    out.append(_lines(filters, 5, "at", 0, "ord", F.concat(F.lit("- "), "table", F.lit(": `"), "filter_expression", F.lit("`"))))
    out.append(_lines(first, 5, "at", 1, zero, ""))
    return reduce(DataFrame.unionByName, out)


def numbered(lines: DataFrame) -> DataFrame:
    """(model_id, n, line) with n counting from 0 in each model."""
    rank = F.row_number().over(Window.partitionBy("model_id").orderBy(*PLACE)) - 1
    return lines.select("model_id", rank.alias("n"), "line")


def text(lines: DataFrame) -> DataFrame:
    """(model_id, text): each model's report in one string."""
    listed = F.array_sort(F.collect_list(F.struct(*PLACE, "line")))
    return lines.groupBy("model_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
