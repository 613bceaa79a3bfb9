"""Models from files of any kind: JSON, text documents, and packages of these or of a column store.

Files are read as bytes by all tasks; each becomes documents (model_id, kind, path, text), from which the readers of this
package make one model of many.
"""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.operators import catalog
from lattica.sources import bim, folders, store, tmdl

SCHEMA = "model_id string, kind string, path string, text string"
DOCUMENT_ENDS = (".tmdl", ".tmd")


class UnknownFormat(ValueError):
    """A file is none of the kinds that are read."""


def sniff(name: str, data: bytes) -> str:
    """bim, tmdl, pbit, pbix, tmdl-zip or bim-zip: by extension and magic, then by a package's members, in this order."""
    low = name.lower()
    if data[:2] != store.ZIP_MAGIC:
        return "tmdl" if low.endswith(DOCUMENT_ENDS) else "bim"
    try:
        members = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except zipfile.BadZipFile as e:
        raise UnknownFormat(f"{name}: {e}") from None
    if "DataModelSchema" in members:
        return "pbit"
    if "DataModel" in members or "Connections" in members:
        return "pbix"
    if any(m.lower().endswith(DOCUMENT_ENDS) for m in members):
        return "tmdl-zip"
    if any(m.lower().endswith("model.bim") for m in members):
        return "bim-zip"
    raise UnknownFormat(f"{name}: no model inside the package")


def decode_schema(data: bytes) -> str:
    """A schema's text: UTF-16LE, with or without a mark."""
    return data.decode("utf-16-le").removeprefix("﻿")


def documents_of(name: str, data: bytes) -> list[tuple[str, str, str]]:
    """(kind, path, text) of a file; a store's metadata comes as JSON rows."""
    kind = sniff(name, data)
    if kind == "bim":
        return [("bim", name, data.decode("utf-8", "replace"))]
    if kind == "tmdl":
        return [("tmdl", name, data.decode("utf-8", "replace"))]
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        members = package.namelist()
        if kind == "pbit":
            return [("pbit", name, decode_schema(package.read("DataModelSchema")))]
        if kind == "pbix":
            if "DataModel" not in members:
                raise UnknownFormat(f"{name}: no model inside the package, only a connection to one")
            rows = store.model_rows(store.metadata(store.archive_of(data)), name)
            return [("pbix", name, json.dumps(rows))]
        if kind == "bim-zip":
            first = next(m for m in members if m.lower().endswith("model.bim"))
            return [("bim", name, package.read(first).decode("utf-8", "replace"))]
        return [("tmdl", m, package.read(m).decode("utf-8", "replace")) for m in members if m.lower().endswith(DOCUMENT_ENDS)]


def documents(files: DataFrame, strict: bool = True) -> DataFrame:
    """Documents of (path, content) files. A file that is none raises; unless strict, it gives a document of the kind `broken` whose text is the reason."""

    def read(path: str, content: bytes) -> list[tuple]:
        try:
            return [(path, *d) for d in documents_of(path, content)]
        except Exception as e:  # whatever a damaged package, archive or database raises
            if strict:
                raise
            return [(path, "broken", path, f"{type(e).__name__}: {e}")]

    def run(batches):
        for pdf in batches:
            rows = [d for p, c in zip(pdf["path"], pdf["content"]) for d in read(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["model_id", "kind", "path", "text"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_models(spark: SparkSession, paths, strict: bool = True) -> catalog.Model:
    """One catalog of the models of all files; a file that is none raises, or is left out unless strict (documents() names it)."""
    return model_of(documents(spark.read.format("binaryFile").load(paths), strict))


def model_of(told: DataFrame) -> catalog.Model:
    """One catalog of the models of documents of all kinds. The documents are written once, as nine tables are made of them."""
    told = folders.written(told)
    parts = []
    for kind in ("bim", "pbit"):
        parts.append(bim.from_json(told.filter(F.col("kind") == kind), kind))
    parts.append(tmdl.from_documents(told.filter("kind = 'tmdl'")))
    # a store's metadata are rows already
    rows = told.filter("kind = 'pbix'")
    tables = {}
    for name, schema in catalog.SCHEMAS.items():
        fields = [x.split(" ", 1) for x in schema.split(", ")]
        listed = F.from_json(F.get_json_object("text", f"$.{name}"), "array<array<string>>")
        one = rows.select(F.explode(listed).alias("r"))
        tables[name] = one.select(*(F.get("r", F.lit(k)).cast(kind).alias(n) if not kind.startswith("array") else F.lit(None).cast(kind).alias(n) for k, (n, kind) in enumerate(fields)))
    parts.append(catalog.Model(**tables))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def read_folder(spark: SparkSession, folder: str) -> catalog.Model:
    """The model of a folder: its first model.bim if there is one, else its text documents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bim").load(folder).select("path").filter(F.lower("path").endswith("model.bim")).orderBy(F.length("path"), "path").head()
    return bim.read_bim(spark, found["path"]) if found else tmdl.read_tmdl(spark, folder)
