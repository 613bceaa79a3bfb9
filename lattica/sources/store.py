"""Tables of a column store: archive index, metadata, columns, and a Spark data source over them.

    spark.dataSource.register(StoreSource)
    spark.read.format("tabular_store").option("path", file).option("table", "Sales").load()

The driver reads the index and the metadata; each task decodes one partition of the table, column by column, and yields
Arrow batches. Pages, dictionaries and segments of other columns are never touched: of an archive that lies in a file as it
is, tasks read only the byte ranges of their own columns; one inside a package or a compressed model is unpacked first.
"""

from __future__ import annotations

import datetime
import html
import re
import sqlite3
import zipfile
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.operators import catalog
from lattica.sources import codecs

METADATA = "metadata.sqlitedb"
ZIP_MAGIC = b"PK"
#: Spark and Arrow types of the store's type ids: fixed values.
SPARK_TYPES = {2: "string", 6: "bigint", 8: "double", 9: "timestamp_ntz", 10: "decimal(19,4)", 11: "boolean", 17: "binary"}
ARROW_TYPES = {2: pa.string(), 6: pa.int64(), 8: pa.float64(), 9: pa.timestamp("us"), 10: pa.decimal128(19, 4), 11: pa.bool_(), 17: pa.binary()}
EPOCH = datetime.datetime(1899, 12, 30)


class Ranged:
    """A file of any file system as far as it is asked for: slices read their range."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        self.file = system.open_input_file(name)

    def __getitem__(self, own: slice) -> bytes:
        first = own.start or 0
        self.file.seek(first)
        return self.file.read(max(0, own.stop - first))


@dataclass
class Archive:
    """Files of an archive by name; compressed ones are unpacked on demand."""

    data: bytes | Ranged
    files: dict[str, tuple[int, int]]
    trimmed: bool
    packed: bool

    def read(self, name: str) -> bytes:
        at, size = self.files[name]
        body = self.data[at : at + size - 4 * self.trimmed]
        return codecs.xpress8_chunks(body) if self.packed else body


def _tag(text: str, name: str) -> str | None:
    m = re.search(f"<{name}>(.*?)</{name}>", text, re.S)
    return m[1] if m else None


def open_archive(data: bytes | Ranged) -> Archive:
    """The index of an archive: a header at byte 72, the virtual directory it points to, and the log that names the files."""
    header = data[72:4096].decode("utf-16-le", "replace").split("\0")[0]
    at, size = int(_tag(header, "m_cbOffsetHeader") or 0), int(_tag(header, "DataSize") or 0)
    if not at or not size:
        raise ValueError("not an archive: its header says nothing of a directory")
    trimmed, packed = _tag(header, "ErrorCode") == "true", _tag(header, "ApplyCompression") == "true"
    directory = data[at : at + size].decode()
    entry = re.compile(r"<BackupFile><Path>(.*?)</Path><Size>(\d+)</Size><m_cbOffsetHeader>(\d+)</m_cbOffsetHeader>")
    stored = {m[1]: (int(m[3]), int(m[2])) for m in entry.finditer(directory)}
    if not stored:
        raise ValueError("the archive's directory is empty")
    at, size = stored[[m[1] for m in entry.finditer(directory)][-1]]
    raw = data[at : at + size - 4 * (trimmed and size > 4)]
    wide = raw[:2] == b"\xff\xfe" or raw[1:2] == b"\0"
    log = raw.decode("utf-16" if raw[:2] == b"\xff\xfe" else "utf-16-le" if wide else "utf-8")
    files = {}
    for m in re.finditer(r"<BackupFile>(.*?)</BackupFile>", log, re.S):
        path, place = _tag(m[1], "Path"), _tag(m[1], "StoragePath")
        if path and place in stored and (name := path.split("\\")[-1]):
            files[name] = stored[place]
    return Archive(data, files, trimmed, packed)


def archive_of(data: bytes | Ranged) -> Archive:
    """The archive in a file: a package, a compressed model, or an archive as it is."""
    if data[:2] == ZIP_MAGIC:
        import io

        with zipfile.ZipFile(data.file if isinstance(data, Ranged) else io.BytesIO(data)) as package:
            data = package.read("DataModel")
    head = data[: codecs.SIGNATURE].decode("utf-16-le", "replace").lower()
    if "xpress9" not in head:
        return open_archive(data)
    return open_archive(codecs.decompress_model(data.file.read() if isinstance(data, Ranged) else data))


def metadata(archive: Archive) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(archive.read(METADATA))
    return db


# The metadata's columns by table, with the places that they have where they go by no name.
COLUMNS = {
    "Table": {"Name": 2, "Description": 4, "IsHidden": 5},
    "Column": {"TableID": 1, "ExplicitName": 2, "ExplicitDataType": 4, "Description": 7, "IsHidden": 8, "ColumnStorageID": 18, "Type": 19, "Expression": 22},
    "ColumnStorage": {"DictionaryStorageID": 4},
    "DictionaryStorage": {"BaseId": 5, "Magnitude": 6, "StorageFileID": 12},
    "ColumnPartitionStorage": {"ColumnStorageID": 1, "StorageFileID": 6},
    "StorageFile": {"FileName": 4},
    "AttributeHierarchy": {"ColumnID": 1, "AttributeHierarchyStorageID": 3},
    "Measure": {"TableID": 1, "Name": 2, "Description": 3, "Expression": 5, "FormatString": 6, "IsHidden": 7},
    "Relationship": {"IsActive": 3, "CrossFilteringBehavior": 5, "FromTableID": 8, "FromColumnID": 9, "FromCardinality": 10, "ToTableID": 11, "ToColumnID": 12, "ToCardinality": 13},
    "Role": {"Name": 2},
    "TablePermission": {"RoleID": 1, "TableID": 2, "FilterExpression": 3},
}


def _rows(db: sqlite3.Connection, table: str, *columns: str) -> list[tuple]:
    """(rowid, these columns) of a table, by their names where the table has them, else by their places; a table that isn't there has none."""
    names = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]
    if not names:
        return []
    at = [names.index(c) if c in names else COLUMNS[table][c] for c in columns]
    return [(r[0], *(r[1 + k] if 1 + k < len(r) else None for k in at)) for r in db.execute(f'SELECT rowid, * FROM "{table}"')]


@dataclass
class StoredColumn:
    name: str
    kind: int
    files: list[str]  # one for each partition, in order
    words: str | None
    base: int
    magnitude: float
    by_value: bool


def _plain(name) -> str:
    return re.sub("<[^>]*>", "", html.unescape(name or "")) if name and "&" in name else name or ""


def _internal(name: str) -> bool:
    return name.startswith(catalog.INTERNAL)


def stored_tables(db: sqlite3.Connection) -> dict[str, list[StoredColumn]]:
    """Columns by table: those of types 1 and 2, without the store's own tables; all partitions of a column."""
    names = {i: _plain(n) for i, n in _rows(db, "Table", "Name")}
    files = {i: n for i, n in _rows(db, "StorageFile", "FileName")}
    storage = {i: d for i, d in _rows(db, "ColumnStorage", "DictionaryStorageID")}
    words = {i: (b, m, f) for i, b, m, f in _rows(db, "DictionaryStorage", "BaseId", "Magnitude", "StorageFileID")}
    parts: dict[int, list[str]] = {}
    for _, column, file in sorted(_rows(db, "ColumnPartitionStorage", "ColumnStorageID", "StorageFileID")):
        if file in files:
            parts.setdefault(column, []).append(files[file])
    indexed = {c for _, c, s in _rows(db, "AttributeHierarchy", "ColumnID", "AttributeHierarchyStorageID") if s is not None}
    out: dict[str, list[StoredColumn]] = {}
    for i, table, name, kind, stored, own in _rows(db, "Column", "TableID", "ExplicitName", "ExplicitDataType", "ColumnStorageID", "Type"):
        if own not in (1, 2) or table not in names or _internal(names[table]) or stored not in storage or stored not in parts:
            continue
        base, magnitude, file = words.get(storage[stored], (0, 1, None))
        out.setdefault(names[table], []).append(StoredColumn(_plain(name), kind, parts[stored], files.get(file), base or 0, magnitude or 1, i in indexed))
    return out


def convert(values: list, kind: int) -> pa.Array:
    """Values as the store's type says: days to timestamps, numbers of four fixed places to decimals, numbers to booleans."""
    if kind == 9:
        values = [None if v is None else EPOCH + datetime.timedelta(milliseconds=round(v * 86400000)) for v in values]
    elif kind == 10:
        values = [None if v is None else Decimal(int(v)).scaleb(-4) for v in values]
    elif kind == 11:
        values = [None if v is None else v != 0 for v in values]
    elif kind == 17:
        values = [v.encode("latin1") if isinstance(v, str) else v for v in values]
    elif kind in (2, None) or kind not in ARROW_TYPES:
        values = [None if v is None else str(v) for v in values]
    elif kind == 6:
        values = [None if v is None else int(v) for v in values]
    return pa.array(values, ARROW_TYPES.get(kind, pa.string()))


def read_column(archive: Archive, column: StoredColumn, part: int) -> pa.Array:
    """A column's values in one partition, all its segments; ids that the dictionary doesn't have are null."""
    return decode_column(column, *stored_bytes(archive, column, part))


def stored_bytes(archive: Archive, column: StoredColumn, part: int) -> tuple[bytes, bytes, bytes | None]:
    """A column's files of one partition: segments, what is said of them, and the dictionary if it has one."""
    if column.words and column.words not in archive.files:
        raise ValueError(f"{column.name}: the archive lacks the dictionary {column.words}")
    name = column.files[part]
    return archive.read(name), archive.read(name + "meta"), archive.read(column.words) if column.words else None


def decode_column(column: StoredColumn, segments: bytes, meta: bytes, words: bytes | None) -> pa.Array:
    """The values in a column's files."""
    info = codecs.segment_info(meta)
    ids = np.concatenate([codecs.segment_ids(e, w, info) for e, w in codecs.segments(segments)] or [np.zeros(0, np.int64)])
    if words is not None:
        values = codecs.dictionary(words)
        index = ids - info.least_id
        known = (index >= 0) & (index < len(values))
        return convert([values[i] if k else None for i, k in zip(index.tolist(), known.tolist())], column.kind)
    if column.by_value:
        return convert(((ids + column.base) / column.magnitude).tolist(), column.kind)
    return convert(ids.tolist(), column.kind)


def read_part(archive: Archive, columns: list[StoredColumn], part: int) -> pa.Table:
    """Columns of a partition side by side; shorter ones are filled up with nulls."""
    return side_by_side([c.name for c in columns], [read_column(archive, c, part) if part < len(c.files) else convert([], c.kind) for c in columns])


def side_by_side(names: list[str], arrays: list[pa.Array]) -> pa.Table:
    rows = max(map(len, arrays), default=0)
    return pa.table([pa.concat_arrays([a, pa.nulls(rows - len(a), a.type)]) for a in arrays], names=names)


class Part(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class StoreReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table")

    def _opened(self) -> tuple[Archive, list[StoredColumn]]:
        archive = archive_of(Ranged(self.path))
        return archive, columns_of(archive, self.table)

    def partitions(self):
        return [Part(k) for k in range(max(len(c.files) for c in self._opened()[1]))]

    def read(self, partition: Part):
        yield from read_part(*self._opened(), partition.number).to_batches(max_chunksize=10_000)


def columns_of(archive: Archive, table: str | None) -> list[StoredColumn]:
    found = stored_tables(metadata(archive))
    if table not in found:
        raise ValueError(f"no table {table!r}; there are {sorted(found)}")
    return found[table]


def _schema(columns) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` {SPARK_TYPES.get(kind, 'string')}" for name, kind in columns)


class StoreSource(DataSource):
    """One table of one store file; options path, a local one or a URI of a file system that Arrow opens, and table."""

    @classmethod
    def name(cls) -> str:
        return "tabular_store"

    def schema(self) -> str:
        return _schema((c.name, c.kind) for c in columns_of(archive_of(Ranged(self.options["path"])), self.options.get("table")))

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options)


def read_table(spark: SparkSession, path: str, table: str):
    """A table of a store at any path that Spark reads. One task reads the file and sends each partition of the table only the bytes of its own columns."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def plan(batches):
        for batch in batches:
            for content in batch.column(0):
                columns = columns_of(archive_of(content.as_py()), table)
                yield pa.RecordBatch.from_pylist([{"name": c.name, "kind": c.kind, "parts": len(c.files)} for c in columns], pa.schema([("name", pa.string()), ("kind", pa.int32()), ("parts", pa.int32())]))

    columns = files.mapInArrow(plan, "name string, kind int, parts int").collect()
    if not columns:
        raise ValueError(f"no file at {path}")
    bytes_of = pa.schema([("part", pa.int32()), ("segments", pa.list_(pa.binary())), ("meta", pa.list_(pa.binary())), ("words", pa.list_(pa.binary())), ("numbers", pa.list_(pa.float64())), ("by_value", pa.list_(pa.bool_()))])

    def cut(batches):
        for batch in batches:
            for content in batch.column(0):
                archive = archive_of(content.as_py())
                own = columns_of(archive, table)
                for part in range(max(len(c.files) for c in own)):
                    read = [stored_bytes(archive, c, part) if part < len(c.files) else (None, None, None) for c in own]
                    segments, meta, words = zip(*read)
                    numbers = [x for c in own for x in (float(c.base), float(c.magnitude))]
                    yield pa.RecordBatch.from_pylist([{"part": part, "segments": segments, "meta": meta, "words": words, "numbers": numbers, "by_value": [c.by_value for c in own]}], bytes_of)

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                arrays = []
                for k, c in enumerate(columns):
                    own = StoredColumn(c["name"], c["kind"], [], None, int(row["numbers"][2 * k]), row["numbers"][2 * k + 1], row["by_value"][k])
                    arrays.append(convert([], c["kind"]) if row["segments"][k] is None else decode_column(own, row["segments"][k], row["meta"][k], row["words"][k]))
                yield from side_by_side([c["name"] for c in columns], arrays).to_batches(max_chunksize=10_000)

    parts = files.mapInArrow(cut, "part int, segments array<binary>, meta array<binary>, words array<binary>, numbers array<double>, by_value array<boolean>")
    columns = [c.asDict() for c in columns]
    return parts.repartition(max(c["parts"] for c in columns), "part").mapInArrow(decode, _schema((c["name"], c["kind"]) for c in columns))


def table_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a store's tables in ascending order, at any path that Spark reads."""

    def names(batches):
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(list(stored_tables(metadata(archive_of(content.as_py())))), pa.string())], ["name"])

    return sorted(r["name"] for r in spark.read.format("binaryFile").load(path).select("content").mapInArrow(names, "name string").collect())


def model_rows(db: sqlite3.Connection, model_id: str) -> dict[str, list[tuple]]:
    """The model's tables as rows, from a store's metadata."""
    from lattica.functions.text import TYPE_NAMES

    kinds = dict(TYPE_NAMES)
    all_names = {i: _plain(n) or f"Table_{i}" for i, n in _rows(db, "Table", "Name")}
    tables = [(i, all_names[i], _plain(d), bool(h)) for i, _, d, h in _rows(db, "Table", "Name", "Description", "IsHidden") if not _internal(all_names[i])]
    seen = {i: n for i, n, _, _ in tables}
    columns = _rows(db, "Column", "TableID", "ExplicitName", "ExplicitDataType", "Description", "IsHidden", "Type", "Expression")
    column_names = {i: _plain(n) for i, _, n, *_ in columns}
    out: dict[str, list[tuple]] = {"models": [(model_id, "Untitled Model", 0, "", "pbix")]}
    out["tables"] = [(model_id, k, n, "import", h, d) for k, (_, n, d, h) in enumerate(tables)]
    out["columns"] = [
        (model_id, seen[t], k, _plain(n), kinds.get(kind, "string"), "calculated" if own == 2 else "data", bool(h), _plain(e) or None, "", None, "", _plain(d))
        for k, (_, t, n, kind, d, h, own, e) in enumerate(columns)
        if t in seen and own != 3
    ]
    out["measures"] = [(model_id, seen[t], k, _plain(n), _plain(e), _plain(f), "", _plain(d), bool(h)) for k, (_, t, n, d, e, f, h) in enumerate(_rows(db, "Measure", "TableID", "Name", "Description", "Expression", "FormatString", "IsHidden")) if t in seen]
    many = lambda v: "many" if v == 2 else "one"
    cards = {("many", "one"): "manyToOne", ("one", "many"): "oneToMany", ("many", "many"): "manyToMany", ("one", "one"): "oneToOne"}
    out["relationships"] = [
        (model_id, k, seen[ft], column_names.get(fc, ""), seen[tt], column_names.get(tc, ""), cards[many(fn), many(tn)], "both" if cross == 2 else "single", active != 0)
        for k, (_, active, cross, ft, fc, fn, tt, tc, tn) in enumerate(_rows(db, "Relationship", "IsActive", "CrossFilteringBehavior", "FromTableID", "FromColumnID", "FromCardinality", "ToTableID", "ToColumnID", "ToCardinality"))
        if ft in seen and tt in seen
    ]
    roles = {i: _plain(n) for i, n in _rows(db, "Role", "Name")}
    out["role_permissions"] = [(model_id, roles[r], k, all_names.get(t, ""), _plain(f)) for k, (_, r, t, f) in enumerate(_rows(db, "TablePermission", "RoleID", "TableID", "FilterExpression")) if r in roles]
    return out
