"""Models from JSON documents: parsed once into VARIANT values, then exploded by laterals into the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.functions import text as tx
from lattica.operators.catalog import Model

# Modes of a partition that decide a table's type, the later one winning: fixed values.
MODE_TYPES = ("directQuery", "dual")


def read_bim(spark: SparkSession, paths) -> Model:
    """Models of JSON files; the file's path is the model's id."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("model_id"), F.col("value").alias("text"))
    return from_json(text)


def broken(documents: DataFrame) -> DataFrame:
    """Ids of documents that aren't JSON."""
    return documents.filter(F.try_parse_json(_bare("text")).isNull()).select("model_id")


def _bare(c: str):
    return F.regexp_replace(c, "^\\x{FEFF}", "")


def _get(path: str, kind: str = "string", of: str = "v"):
    return F.try_variant_get(of, path, kind)


def _text(path: str, of: str = "v"):
    """A text, or an array of lines."""
    lines = F.try_variant_get(of, path, "array<string>")
    return F.coalesce(F.array_join(lines, "\n"), F.try_variant_get(of, path, "string"))


def _or(c, default):
    return F.coalesce(c, F.lit(default))


def from_json(documents: DataFrame, source_format: str = "bim") -> Model:
    """The model's tables of (model_id, text) documents, many models at once. Documents that aren't JSON give nothing; broken() names them."""
    roots = documents.select("model_id", F.try_parse_json(_bare("text")).alias("doc")).filter("doc IS NOT NULL")
    roots = roots.withColumn("root", F.coalesce(F.try_variant_get("doc", "$.model", "variant"), F.col("doc")))

    def explode(df: DataFrame, path: str, of: str, *keep: str) -> DataFrame:
        """Members of an array as rows (keep..., ord, v)."""
        members = F.try_variant_get(of, path, "array<variant>")
        return df.select("model_id", *keep, F.posexplode(members).alias("ord", "v"))

    names = explode(roots, "$.tables", "root").withColumn("table", _or(_get("$.name"), ""))
    of_table = lambda path: explode(names.select("model_id", "table", F.col("v").alias("t")), path, "t", "table")

    parts = of_table("$.partitions")
    kind = _get("$.source.type")
    parts = parts.select(
        "model_id",
        "table",
        "ord",
        F.when(kind.isin("m", "powerQuery"), "m").when(kind.isin("calculated", "query", "entity"), kind).otherwise("unknown").alias("type"),
        _or(F.when(kind.isin("m", "powerQuery", "calculated"), _text("$.source.expression")).when(kind == "query", _text("$.source.query")).when(kind == "entity", _get("$.source.entityName")), "").alias("expression"),
        _or(_get("$.mode"), "").alias("mode"),
    )
    # a table's type is what its last partition says that says anything
    says = F.when(F.col("mode").isin(*MODE_TYPES), F.col("mode")).when(F.col("type") == "calculated", F.lit("calculated"))
    typed = parts.withColumn("says", says).filter("says IS NOT NULL").groupBy("model_id", "table").agg(F.max_by("says", "ord").alias("says"))
    group = _get("$.calculationGroup", "variant").isNotNull()
    tables = names.select("model_id", "ord", F.col("table").alias("name"), group.alias("is_group"), _or(_get("$.isHidden", "boolean"), False).alias("is_hidden"), _or(_text("$.description"), "").alias("description"))
    tables = tables.join(typed.withColumnRenamed("table", "name"), ["model_id", "name"], "left")
    tables = tables.select("model_id", "ord", "name", F.coalesce("says", F.when(F.col("is_group"), "calculated").otherwise("import")).alias("type"), "is_hidden", "description")

    columns = of_table("$.columns").filter(_or(_get("$.type"), "data") != "rowNumber").select(
        "model_id", "table", "ord", _or(_get("$.name"), "").alias("name"), _or(_get("$.dataType"), "string").alias("data_type"),
        F.when(_get("$.type") == "calculated", "calculated").otherwise("data").alias("type"), _or(_get("$.isHidden", "boolean"), False).alias("is_hidden"), _text("$.expression").alias("expression"),
        _or(_get("$.formatString"), "").alias("format_string"), _get("$.sortByColumn").alias("sort_by_column"), _or(_get("$.displayFolder"), "").alias("display_folder"), _or(_text("$.description"), "").alias("description"),
    )
    measures = of_table("$.measures").select(
        "model_id", "table", "ord", _or(_get("$.name"), "").alias("name"), _or(_text("$.expression"), "").alias("expression"), _or(_get("$.formatString"), "").alias("format_string"),
        _or(_get("$.displayFolder"), "").alias("display_folder"), _or(_text("$.description"), "").alias("description"), _or(_get("$.isHidden", "boolean"), False).alias("is_hidden"),
    )
    level = lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.column", "string"), F.lit(""))
    hierarchies = of_table("$.hierarchies").select("model_id", "table", "ord", _or(_get("$.name"), "").alias("name"), F.coalesce(F.transform(_get("$.levels", "array<variant>"), level), F.array().cast("array<string>")).alias("levels"))
    items = of_table("$.calculationGroup.calculationItems").select("model_id", "table", "ord", _or(_get("$.name"), "").alias("name"), _or(_text("$.expression"), "").alias("expression"), _or(_get("$.ordinal", "int"), 0).alias("ordinal"))

    crossing = _get("$.crossFilteringBehavior")
    relationships = explode(roots, "$.relationships", "root").select(
        "model_id", "ord", *(_or(_get(f"$.{j}"), "").alias(n) for j, n in (("fromTable", "from_table"), ("fromColumn", "from_column"), ("toTable", "to_table"), ("toColumn", "to_column"))),
        tx.cardinality(_get("$.fromCardinality"), _get("$.toCardinality")).alias("cardinality"),
        F.when(crossing.isin("bothDirections", "bothWays"), "both").otherwise("single").alias("cross_filter_direction"), _or(_get("$.isActive", "boolean"), True).alias("is_active"),
    )
    roles = explode(roots, "$.roles", "root").select("model_id", F.col("ord").alias("at"), _or(_get("$.name"), "").alias("role"), F.posexplode_outer(_get("$.tablePermissions", "array<variant>")).alias("p", "v"))
    roles = roles.select("model_id", "role", (F.col("at") * 10000 + F.coalesce("p", F.lit(0))).cast("int").alias("ord"), F.when(F.col("v").isNotNull(), F.coalesce(_get("$.name"), _get("$.table"), F.lit(""))).alias("table"), F.when(F.col("v").isNotNull(), _or(_text("$.filterExpression"), "")).alias("filter_expression"))

    models = roots.select(
        "model_id", F.coalesce(F.try_variant_get("doc", "$.name", "string"), F.try_variant_get("root", "$.name", "string"), F.lit("Untitled Model")).alias("name"),
        F.coalesce(F.try_variant_get("doc", "$.compatibilityLevel", "int"), F.lit(0)).alias("compatibility_level"), F.coalesce(F.try_variant_get("root", "$.culture", "string"), F.lit("")).alias("culture"), F.lit(source_format).alias("source_format"),
    )
    return Model(models, tables, columns, measures, hierarchies, parts, items, relationships, roles)
