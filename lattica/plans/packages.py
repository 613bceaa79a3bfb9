"""The model of the driver's tables written in each of the forms that models come in, and read again."""

from __future__ import annotations

import io
import json
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lattica.operators import catalog
from lattica.plans import models
from lattica.plans.registry import query
from lattica.sources import folders, package


def _columns(table, name: str) -> list[tuple[str, str]]:
    return [] if name in models.HIDDEN[1:] else [(c, models.DATA_TYPES.get(kind, "string")) for c, kind in table(name).dtypes]


def _sorted_by(column: str, first: str) -> str | None:
    return first if column.endswith("_name") else None


def _as_json(table) -> dict:
    """The model as a JSON document: expressions as arrays of lines, columns with what they are sorted by, hierarchies over dates."""
    tables = []
    for t in models.TABLES:
        columns, kind = _columns(table, t), models.KINDS.get(t, "import")
        source = {"type": "calculated", "expression": "ROW()"} if kind == "calculated" else {"type": "m", "expression": ["let", "  x = 1", "in x"]}
        tables.append(
            {
                "name": t,
                "isHidden": t in models.HIDDEN,
                "columns": [{"name": "RowNumber", "type": "rowNumber", "dataType": "int64"}] + [{"name": c, "dataType": d, "isHidden": c.endswith("key")} | ({"sortByColumn": s} if (s := _sorted_by(c, columns[0][0])) else {}) for c, d in columns],
                "measures": [{"name": n, "expression": [e], "displayFolder": f, "isHidden": h} for u, n, e, f, h in models.MEASURES if u == t],
                "hierarchies": [{"name": f"By {c}", "levels": [{"name": c}, {"column": columns[0][0]}]} for c, d in columns if d == "dateTime"],
                "partitions": [{"source": source} | ({"mode": kind} if kind != "calculated" else {})],
            }
        )
    ends = {"manyToOne": {}, "oneToOne": {"fromCardinality": "one", "toCardinality": "one"}}
    relationships = [
        {"fromTable": a, "fromColumn": b, "toTable": c, "toColumn": d, "isActive": active} | ends[card] | ({"crossFilteringBehavior": "bothDirections"} if both == "both" else {}) for a, b, c, d, card, both, active in models.RELATIONSHIPS
    ]
    roles: dict[str, list] = {}
    for role, t, rule in models.ROLES:
        roles.setdefault(role, []).extend([{"name": t, "filterExpression": rule}] if t else [])
    return {"name": "Driver", "compatibilityLevel": 1604, "model": {"culture": "en-US", "tables": tables, "relationships": relationships, "roles": [{"name": r, "tablePermissions": p} for r, p in roles.items()]}}


def _quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def _as_documents(table) -> dict[str, str]:
    """The model as indented documents by path, from what its JSON form says."""
    model = _as_json(table)["model"]
    out = {"database.tmdl": "database Driver\n\tcompatibilityLevel: 1604\n", "model.tmdl": "model Driver\n\tculture: en-US\n"}
    for k, t in enumerate(model["tables"]):
        lines = [f"table {_quoted(t['name'])}", *(["\tisHidden"] if t["isHidden"] else []), ""]
        for m in t["measures"]:
            lines += [f"\tmeasure {_quoted(m['name'])} =", *(f"\t\t\t{x}" for x in m["expression"]), f"\t\tdisplayFolder: {m['displayFolder']}", *(["\t\tisHidden"] if m["isHidden"] else []), ""]
        for c in t["columns"][1:]:
            lines += [f"\tcolumn {_quoted(c['name'])}", f"\t\tdataType: {c['dataType']}", *(["\t\tisHidden"] if c["isHidden"] else []), *([f"\t\tsortByColumn: {_quoted(c['sortByColumn'])}"] if "sortByColumn" in c else []), ""]
        for h in t["hierarchies"]:
            lines += [f"\thierarchy {_quoted(h['name'])}", *(f"\t\tlevel {_quoted(x.get('name') or x['column'])}" for x in h["levels"]), ""]
        for p in t["partitions"]:
            lines += [f"\tpartition p = {p['source']['type']}", *([f"\t\tmode: {p['mode']}"] if "mode" in p else []), "\t\tsource = ROW()"]
        out[f"tables/{k:02d}.tmdl"] = "\n".join(lines) + "\n"
    related = []
    for k, r in enumerate(model["relationships"]):
        told = [f"\t{key}: {str(r[key]).lower() if key == 'isActive' else r[key]}" for key in ("isActive", "crossFilteringBehavior", "fromCardinality", "toCardinality") if key in r]
        related += [f"relationship r{k}", *told, f"\tfromColumn: {_quoted(r['fromTable'])}.{_quoted(r['fromColumn'])}", f"\ttoColumn: {_quoted(r['toTable'])}.{_quoted(r['toColumn'])}", ""]
    out["relationships.tmdl"] = "\n".join(related)
    for r in model["roles"]:
        out[f"roles/{r['name']}.tmdl"] = "\n".join([f"role {r['name']}", *(f"\ttablePermission {_quoted(p['name'])}" + (f" = {p['filterExpression']}" if p["filterExpression"] else "") for p in r["tablePermissions"])]) + "\n"
    return out


def _zipped(members: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def _objects(model: catalog.Model) -> DataFrame:
    """(kind, owner, name, says) of a model's objects."""

    def told(df: DataFrame, kind: str, owner, name, *says) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(name, F.lit("")).alias("name"), F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("")) if isinstance(x, str) else x for x in says)).alias("says"))

    c = F.col
    return reduce(
        DataFrame.unionByName,
        (
            told(model.tables, "table", F.lit(""), c("name"), "type", "is_hidden"),
            told(model.columns, "column", c("table"), c("name"), "data_type", "is_hidden", "sort_by_column"),
            told(model.measures, "measure", c("table"), c("name"), "expression", "display_folder", "is_hidden"),
            told(model.hierarchies, "hierarchy", c("table"), c("name"), F.array_join("levels", ">")),
            told(model.relationships, "relationship", c("from_table"), c("from_column"), "to_table", "to_column", "cardinality", "cross_filter_direction", "is_active"),
            told(model.role_permissions, "role", c("role"), c("table"), "filter_expression"),
        ),
    )


_COLUMNS = models._C.replace("c(tbl, name) AS (SELECT table_name, column_name", "c(tbl, name, data_type, place) AS (SELECT table_name, column_name, data_type, ordinal_position")
_KIND = "CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'int64' WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type LIKE 'TIMESTAMP%' THEN 'dateTime' ELSE 'string' END"
_FIRST = "(SELECT f.name FROM c f WHERE f.tbl = c.tbl ORDER BY place LIMIT 1)"
_SQL = f"""
WITH {models._T}, {models._M}, {models._R}, {models._P}, {_COLUMNS}
SELECT 'table' AS kind, '' AS owner, name, type || '|' || is_hidden AS says FROM t
UNION ALL SELECT 'column', tbl, name, {_KIND} || '|' || ends_with(name, 'key') || '|' || CASE WHEN ends_with(name, '_name') THEN {_FIRST} ELSE '' END FROM c
UNION ALL SELECT 'measure', tbl, name, expression || '|' || folder || '|' || is_hidden FROM m
UNION ALL SELECT 'hierarchy', tbl, 'By ' || name, name || '>' || {_FIRST} FROM c WHERE data_type LIKE 'TIMESTAMP%'
UNION ALL SELECT 'relationship', ft, fc, tt || '|' || tc || '|' || card || '|' || dir || '|' || active FROM r
UNION ALL SELECT 'role', role, coalesce(tbl, ''), coalesce(filter, '') FROM p
"""


@query(_SQL)
def model_json(table, spark):
    """A folder with a JSON document in it."""
    path = folders.shared(spark)
    folders.put(spark, f"{path}/Driver.SemanticModel/model.bim", json.dumps(_as_json(table)).encode())
    return _objects(package.read_folder(spark, path))


@query(_SQL)
def model_documents(table, spark):
    """A folder of indented documents."""
    path = folders.shared(spark)
    for name, text in _as_documents(table).items():
        folders.put(spark, f"{path}/definition/{name}", text.encode())
    return _objects(package.read_folder(spark, path))


@query(_SQL)
def model_template(table, spark):
    """A package with a schema in UTF-16."""
    path = folders.shared(spark)
    folders.put(spark, f"{path}/driver.pbit", _zipped({"DataModelSchema": ("﻿" + json.dumps(_as_json(table))).encode("utf-16-le")}))
    return _objects(package.read_models(spark, path))


@query(_SQL)
def model_project(table, spark):
    """A package of indented documents."""
    path = folders.shared(spark)
    folders.put(spark, f"{path}/driver.zip", _zipped({f"Driver.SemanticModel/definition/{n}": t for n, t in _as_documents(table).items()}))
    return _objects(package.read_models(spark, path))


@query("SELECT * FROM (VALUES ('a.pbit', 'pbit'), ('b.zip', 'bim'), ('c.zip', 'tmdl'), ('d.tmdl', 'tmdl'), ('e.bim', 'bim'), ('f.json', 'bim'), ('g.pbix', 'broken'), ('h.zip', 'broken'), ('i.zip', 'broken')) v(file, kind)")
def model_kinds(table, spark):
    """What files are told for, by name, magic and members; a live connection, a package without a model and a damaged one aren't models."""
    text = json.dumps(_as_json(table))
    path, document = folders.shared(spark), "table t\n\tcolumn c\n"
    files = {
        "a.pbit": _zipped({"DataModelSchema": text.encode("utf-16-le"), "x/model.bim": text}), "b.zip": _zipped({"x/Model.BIM": text}), "c.zip": _zipped({"x/tables/t.TMDL": document, "x/model.bim": text}), "d.tmdl": document.encode(), "e.bim": text.encode(),
        "f.json": text.encode(), "g.pbix": _zipped({"Connections": "{}"}), "h.zip": _zipped({"readme": ""}), "i.zip": b"PK\x03\x04 cut",
    }
    for name, data in files.items():
        folders.put(spark, f"{path}/{name}", data)
    told = package.documents(spark.read.format("binaryFile").load(path), strict=False)
    return told.select(F.substring_index("model_id", "/", -1).alias("file"), "kind").distinct()
