"""Models from sets of indented text documents.

A document is read into a tree of objects by one reader for all kinds: an object is a keyword with a name, properties
stand one level deeper, an expression after `=` stands on the line, between fences, or two levels deeper. The objects of
all documents of all models come out as one table, from which the model's tables are projections.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.functions import text as tx
from lattica.operators.catalog import SCHEMAS, Model
from lattica.sources import folders

#: Words that begin an object: fixed values.
OBJECTS = ("table", "column", "measure", "partition", "hierarchy", "level", "calculationGroup", "calculationItem", "relationship", "role", "tablePermission", "model", "database", "expression", "annotation", "kpi", "queryGroup", "ref", "cultureInfo", "perspective", "extendedProperty", "variation", "member", "changedProperty", "linguisticMetadata", "formatStringDefinition", "detailRowsDefinition")
#: Of these, those whose own line may go on with an expression.
_HEAD = re.compile(rf"({'|'.join(OBJECTS)})(?:\s+('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[^=]*?))?\s*(?:=(.*))?$", re.S)
_PROPERTY = re.compile(r"([A-Za-z_][\w.]*)\s*(:|=)\s?(.*)$", re.S)
_FLAG = re.compile(r"[A-Za-z_]\w*$")
FENCE = "```"

SCHEMA = "model_id string, path string, id int, parent int, kind string, name string, expression string, description string, ord int, props map<string,string>"


@dataclass
class Node:
    kind: str
    name: str
    depth: int
    expression: str = ""
    description: str = ""
    props: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)


def indent(line: str) -> int:
    """Depth of a line: a tab counts one, a space a quarter, rounded down."""
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return int(lead.count("\t") + lead.count(" ") / 4)


def unquote(name: str) -> str:
    name = name.strip()
    for q in "'\"":
        if len(name) >= 2 and name[0] == q == name[-1]:
            return name[1:-1].replace(q * 2, q)
    return name


def _dedent(lines: list[str]) -> str:
    """Lines without the white space that all have in front, and without blank lines at either end."""
    while lines and not lines[0].strip():
        lines = lines[1:]
    while lines and not lines[-1].strip():
        lines = lines[:-1]
    common = min((len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()), default=0)
    return "\n".join(x[common:].rstrip() for x in lines)


class Reader:
    """The tree of one document."""

    def __init__(self, text: str):
        self.lines, self.at = text.lstrip("﻿").replace("\r\n", "\n").split("\n"), 0

    def tree(self) -> list[Node]:
        top = Node("document", "", -1)
        self._children(top)
        return top.children

    def _children(self, parent: Node) -> None:
        notes: list[str] = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body, depth = line.strip(), indent(line)
            if not body:
                self.at += 1
                continue
            if depth <= parent.depth:
                return
            self.at += 1
            if body.startswith("///"):
                notes.append(body[3:].strip())
                continue
            if body.startswith("//"):
                continue
            head = _HEAD.match(body)
            if head and self._is_object(head, body):
                node = Node(head[1], unquote(head[2] or ""), depth, description="\n".join(notes))
                if head[3] is not None:
                    node.expression = self._expression(head[3], depth, 2)
                parent.children.append(node)
                self._children(node)
            elif m := _PROPERTY.match(body):
                parent.props[m[1]] = self._expression(m[3], depth, 1) if m[2] == "=" else m[3].strip()
            elif _FLAG.match(body):
                parent.props[body] = "true"
            notes = []

    @staticmethod
    def _is_object(head: re.Match, body: str) -> bool:
        # a property can have the name of an object: `column: Year` in a level
        return not body[len(head[1]) :].lstrip().startswith(":")

    def _expression(self, rest: str, depth: int, deeper: int) -> str:
        """What stands after `=`: on the line, between fences, or on lines that are `deeper` levels down at least."""
        rest = rest.strip()
        if rest.startswith(FENCE):
            first, lines = rest[len(FENCE) :], []
            if first.rstrip().endswith(FENCE) and first.strip():
                return first.strip()[: -len(FENCE)].strip()
            while self.at < len(self.lines):
                line = self.lines[self.at]
                self.at += 1
                if line.strip().endswith(FENCE):
                    lines.append(line.rstrip()[: -len(FENCE)])
                    break
                lines.append(line)
            return _dedent(([first] if first.strip() else []) + lines)
        if rest:
            return rest
        lines = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip() and indent(line) < depth + deeper:
                break
            lines.append(line)
            self.at += 1
        return _dedent(lines)


def objects(text: str) -> list[dict]:
    """A document's objects in order, each with its number and its parent's."""
    out: list[dict] = []

    def walk(nodes: list[Node], parent: int) -> None:
        seen: dict[str, int] = {}
        for n in nodes:
            ord_ = seen.setdefault(n.kind, 0)
            seen[n.kind] += 1
            own = len(out)
            out.append({"id": own, "parent": parent, "kind": n.kind, "name": n.name, "expression": n.expression, "description": n.description, "ord": ord_, "props": n.props})
            walk(n.children, own)

    walk(Reader(text).tree(), -1)
    return out


def parse(documents: DataFrame) -> DataFrame:
    """All objects of (model_id, path, text) documents, parsed where the documents lie."""

    def run(batches):
        for pdf in batches:
            rows = [{"model_id": m, "path": p, **o} for m, p, t in zip(pdf["model_id"], pdf["path"], pdf["text"]) for o in objects(t or "")]
            if rows:
                yield pd.DataFrame(rows)

    return documents.select("model_id", "path", "text").mapInPandas(run, SCHEMA)


def read_tmdl(spark: SparkSession, folders: list[str] | str) -> Model:
    """Models of folders of documents, a model for each folder; the folder is the model's id."""
    parts = []
    for folder in [folders] if isinstance(folders, str) else folders:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tmd*").text(folder, wholetext=True)
        parts.append(files.select(F.lit(folder).alias("model_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return from_documents(out)


def _prop(name: str):
    return F.element_at("props", name)


def _flag(name: str):
    return F.coalesce(F.lower(_prop(name)) != "false", F.lit(False))


def from_documents(documents: DataFrame) -> Model:
    """The model's tables of (model_id, path, text) documents. Tables and roles come in order of their documents' paths."""
    # the parsed objects are read nine times
    found = folders.written(parse(documents))
    path = F.lower("path")
    of = lambda kind: found.filter(F.col("kind") == kind)
    own = ["model_id", "path", "id"]

    tables = of("table").filter(F.contains(path, F.lit("tables/")) & (F.col("parent") == -1))
    named = tables.select("model_id", "path", F.col("id").alias("parent"), F.col("name").alias("table"))
    in_table = lambda kind: of(kind).join(named, ["model_id", "path", "parent"])

    said = F.lower(F.trim("expression"))
    parts = in_table("partition").select(
        "model_id", "table", "ord",
        F.when(said.isin("m", "calculated", "query", "entity", "dax"), said).otherwise("unknown").alias("type"),
        F.coalesce(_prop("source"), _prop("expression"), F.lit("")).alias("expression"), F.coalesce(_prop("mode"), F.lit("")).alias("mode"),
    )
    says = F.when(F.col("mode").isin("directQuery", "dual"), F.col("mode")).when(F.col("type") == "calculated", F.lit("calculated"))
    typed = parts.withColumn("says", says).filter("says IS NOT NULL").groupBy("model_id", "table").agg(F.max_by("says", "ord").alias("says"))
    groups = in_table("calculationGroup").select("model_id", "table", F.lit("calculated").alias("is_group")).distinct()
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("model_id").orderBy("path", "id")) - 1
    told = tables.withColumn("at", place).withColumn("table", F.col("name")).join(typed, ["model_id", "table"], "left").join(groups, ["model_id", "table"], "left")
    out = {"tables": told.select("model_id", F.col("at").cast("int").alias("ord"), "name", F.coalesce("says", "is_group", F.lit("import")).alias("type"), _flag("isHidden").alias("is_hidden"), F.coalesce(_prop("description"), F.lit("")).alias("description"))}

    text_of = lambda name: F.coalesce(_prop(name), F.lit(""))
    described = F.coalesce(_prop("description"), F.col("description"), F.lit(""))
    is_calculated = F.col("expression") != ""
    out["columns"] = in_table("column").select(
        "model_id", "table", "ord", "name", F.coalesce(_prop("dataType"), F.lit("string")).alias("data_type"), F.when(is_calculated, "calculated").otherwise("data").alias("type"), _flag("isHidden").alias("is_hidden"),
        F.nullif("expression", F.lit("")).alias("expression"), text_of("formatString").alias("format_string"), tx.unquote_ident(_prop("sortByColumn")).alias("sort_by_column"), text_of("displayFolder").alias("display_folder"), described.alias("description"),
    )
    out["measures"] = in_table("measure").select("model_id", "table", "ord", "name", "expression", text_of("formatString").alias("format_string"), text_of("displayFolder").alias("display_folder"), described.alias("description"), _flag("isHidden").alias("is_hidden"))
    hierarchies = in_table("hierarchy").select("model_id", "path", F.col("id").alias("parent"), "table", F.col("ord").alias("at"), F.col("name").alias("hierarchy"))
    levels = of("level").select("model_id", "path", "parent", "ord", "name").join(hierarchies, ["model_id", "path", "parent"], "right")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("ord", "name")))), lambda x: x["name"])
    out["hierarchies"] = levels.groupBy("model_id", "table", F.col("at").alias("ord"), F.col("hierarchy")).agg(listed.alias("levels")).withColumnRenamed("hierarchy", "name")
    out["partitions"] = parts
    group_ids = in_table("calculationGroup").select("model_id", "path", F.col("id").alias("parent"), "table")
    items = of("calculationItem").join(group_ids, ["model_id", "path", "parent"]).unionByName(in_table("calculationItem"))
    out["calculation_items"] = items.select("model_id", "table", "ord", "name", "expression", F.coalesce(_prop("ordinal").try_cast("int"), F.lit(0)).alias("ordinal"))
    from_table, from_column = tx.qualified_name(_prop("fromColumn"))
    to_table, to_column = tx.qualified_name(_prop("toColumn"))
    from_end, to_end = F.coalesce(_prop("fromCardinality"), F.lit("many")), F.coalesce(_prop("toCardinality"), F.lit("one"))
    out["relationships"] = of("relationship").select(
        "model_id", "ord", F.coalesce(from_table, F.lit("")).alias("from_table"), F.coalesce(from_column, F.lit("")).alias("from_column"), F.coalesce(to_table, F.lit("")).alias("to_table"), F.coalesce(to_column, F.lit("")).alias("to_column"),
        tx.cardinality(from_end, to_end).alias("cardinality"), F.when(_prop("crossFilteringBehavior").isin("bothDirections", "bothWays"), "both").otherwise("single").alias("cross_filter_direction"),
        F.coalesce(F.lower(_prop("isActive")) != "false", F.lit(True)).alias("is_active"),
    )
    roles = of("role").filter(F.contains(path, F.lit("roles/"))).select(*own, F.col("name").alias("role")).withColumnRenamed("id", "parent")
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("path", "parent", "ord")) - 1
    permissions = roles.join(of("tablePermission").select("model_id", "path", "parent", "ord", F.col("name").alias("table"), "expression"), ["model_id", "path", "parent"], "left")
    out["role_permissions"] = permissions.select("model_id", "role", place.cast("int").alias("ord"), "table", F.col("expression").alias("filter_expression"))

    level = F.max(F.when(F.col("kind") == "database", _prop("compatibilityLevel").try_cast("int")))
    culture = F.max(F.when(F.col("kind") == "model", _prop("culture")))
    name = F.max(F.when((F.col("kind") == "model") & (F.col("name") != ""), F.col("name")))
    out["models"] = found.groupBy("model_id").agg(name.alias("name"), level.alias("compatibility_level"), culture.alias("culture")).select("model_id", F.coalesce("name", F.lit("TMDL Model")).alias("name"), F.coalesce("compatibility_level", F.lit(0)).alias("compatibility_level"), F.coalesce("culture", F.lit("")).alias("culture"), F.lit("tmdl").alias("source_format"))
    assert set(out) == set(SCHEMAS)
    return Model(**out)
