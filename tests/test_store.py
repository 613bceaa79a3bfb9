"""Round trips with encoders written from the layouts: they show that readers and layouts agree, not that files of other makers are read."""

import datetime
import io
import json
import random
import sqlite3
import struct
import zipfile
from decimal import Decimal

import numpy as np
import pytest

from lattica.sources import codecs, package, store


def pack(values, width):
    each, out = 64 // width, []
    for k in range(0, len(values), each):
        word = 0
        for j, v in enumerate(values[k : k + each]):
            word |= v << width * j
        out.append(word)
    return out


def info_bytes(least, packed, width, rows):
    a, b = 36, width  # 36 - a + b
    return (
        bytes(36) + struct.pack("<II", a, b) + bytes(24 + 1 + 4) + bytes(6 + 8) + struct.pack("<I", least) + bytes(4 + 4 + 8) + struct.pack("<Q", rows) + bytes(1 + 8 + 8 + 6) + bytes(1) + bytes(6) + struct.pack("<Q", packed)
    )


def segment_bytes(entries, words):
    return struct.pack("<Q", len(entries)) + b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<Q", len(words)) + b"".join(struct.pack("<Q", w) for w in words)


def encode_ids(ids, least, width):
    """Runs of three and more as runs, the rest packed."""
    entries, packed, k = [], [], 0
    while k < len(ids):
        n = 1
        while k + n < len(ids) and ids[k + n] == ids[k]:
            n += 1
        if n >= 3:
            entries.append((ids[k], n))
        else:
            if entries and entries[-1][0] == "p":
                entries[-1] = ("p", entries[-1][1] + n, entries[-1][2])
            else:
                entries.append(("p", n, len(packed)))
            packed += [i - least for i in ids[k : k + n]]
        k += n
    told = [(codecs.PACKED - e[2], e[1]) if e[0] == "p" else e for e in entries]
    return told, pack(packed, width), len(packed)


def column_files(ids, least=3):
    width = max(1, (max(ids) - least).bit_length()) if ids else 1
    entries, words, packed = encode_ids(ids, least, width)
    return segment_bytes(entries, words), info_bytes(least, packed, width, len(ids))


def plain_dictionary(strings):
    text = "".join(s + "\0" for s in strings).encode("utf-16-le")
    page = bytes(8 + 1 + 8) + struct.pack("<Q", len(strings)) + b"\0" + bytes(4) + bytes(16) + struct.pack("<Q", len(text)) + text + bytes(4)
    return struct.pack("<i", 2) + bytes(24) + bytes(17) + struct.pack("<q", 1) + page + struct.pack("<QI", 0, 8)


def huffman_dictionary(strings):
    used = sorted(set("".join(strings).encode("latin1")))
    lengths = np.zeros(256, int)
    depth = max(1, (len(used) - 1).bit_length())
    lengths[used] = depth
    codes = {s: (n, c) for (n, c), s in codecs.huffman_codes(lengths).items()}
    bits, starts = [], []
    for s in strings:
        starts.append(len(bits))
        for b in s.encode("latin1"):
            n, c = codes[b]
            bits += [c >> n - 1 - k & 1 for k in range(n)]
    raw = np.packbits(bits + [0] * (-len(bits) % 16)).reshape(-1, 2)[:, ::-1].tobytes()
    table = bytes(int(lengths[2 * k] | lengths[2 * k + 1] << 4) for k in range(128))
    page = bytes(17) + struct.pack("<Q", len(strings)) + b"\1" + bytes(4) + struct.pack("<IIQ", len(bits), 0, len(raw)) + bytes(5) + table + bytes(8) + raw + bytes(4)
    handles = struct.pack("<QI", len(strings), 8) + b"".join(struct.pack("<II", s, 0) for s in starts)
    return struct.pack("<i", 2) + bytes(24) + bytes(17) + struct.pack("<q", 1) + page + handles


def number_dictionary(values, kind, size):
    form = {4: "i", 8: "q" if kind == 0 else "d"}[size]
    return struct.pack("<i", kind) + bytes(24) + struct.pack("<QI", len(values), size) + b"".join(struct.pack("<" + form, v) for v in values)


def chunked(data):
    """Chunks stored as they are, and one of literals and a reference."""
    return struct.pack("<II", len(data), len(data)) + data


def archive_bytes(files, trimmed=False, packed=False, wide_log=True):
    body, directory = bytearray(4096), []
    log = "".join(f"<BackupFile><Path>x\\{n}</Path><StoragePath>s{k}</StoragePath><Size>{len(d)}</Size></BackupFile>" for k, (n, d) in enumerate(files.items()))
    raw = {f"s{k}": chunked(d) if packed else d for k, d in enumerate(files.values())}
    raw["log"] = ("﻿" + log).encode("utf-16-le") if wide_log else log.encode()
    for name, data in raw.items():
        data += bytes(4) * trimmed
        directory.append(f"<BackupFile><Path>{name}</Path><Size>{len(data)}</Size><m_cbOffsetHeader>{len(body)}</m_cbOffsetHeader></BackupFile>")
        body += data
    told = "".join(directory).encode()
    header = f"<BackupLog><m_cbOffsetHeader>{len(body)}</m_cbOffsetHeader><DataSize>{len(told)}</DataSize><ErrorCode>{str(trimmed).lower()}</ErrorCode><ApplyCompression>{str(packed).lower()}</ApplyCompression></BackupLog>".encode("utf-16-le")
    body[72 : 72 + len(header)] = header
    return bytes(body + told)


def metadata_bytes(named=False):
    """Tables whose columns go by their places, or by name in another order."""
    db = sqlite3.connect(":memory:")
    widths = {"Table": 8, "Column": 24, "ColumnStorage": 12, "DictionaryStorage": 14, "ColumnPartitionStorage": 8, "StorageFile": 6, "AttributeHierarchy": 5, "AttributeHierarchyStorage": 11, "Measure": 9, "Relationship": 15, "Role": 4, "TablePermission": 5}
    name_of = {t: {k: c for c, k in store.COLUMNS.get(t, {}).items()} if named else {} for t in widths}
    column = lambda t, k: name_of[t].get(k, f"c{k}")
    for t, n in widths.items():
        order = range(n)[::-1] if named else range(n)
        db.execute(f'CREATE TABLE "{t}" (' + ", ".join(column(t, k) for k in order) + ")")

    def put(t, rowid, **at):
        values = [None] * widths[t]
        for k, v in at.items():
            values[int(k[1:])] = v
        db.execute(f'INSERT INTO "{t}" (rowid, ' + ", ".join(column(t, k) for k in range(widths[t])) + ") VALUES (?" + ", ?" * widths[t] + ")", (rowid, *values))

    put("Table", 1, _2="Sales &amp; More", _4="about", _5=0)
    put("Table", 2, _2="H$Sales", _5=1)
    put("Table", 3, _2="Dates", _5=1)
    columns = [("Name", 2, 1), ("Code", 2, 1), ("Amount", 10, 1), ("When", 9, 1), ("Flag", 11, 1), ("Count", 6, 2), ("Ratio", 8, 1), ("RowNumber", 6, 3)]
    for k, (n, kind, own) in enumerate(columns, 1):
        put("Column", k, _1=1, _2=n, _4=kind, _8=int(n == "Code"), _18=k, _19=own, _22="1 + 1" if own == 2 else None)
        put("ColumnStorage", k, _4=k if n != "Count" else 50)
        put("DictionaryStorage", k, _5=0, _6=1, _12=100 + k)
        for part in (0, 1):
            put("ColumnPartitionStorage", 10 * k + part, _1=k, _6=200 + 10 * k + part)
            put("StorageFile", 200 + 10 * k + part, _4=f"{n}.{part}.idf")
        put("StorageFile", 100 + k, _4=f"{n}.dict")
    put("DictionaryStorage", 50, _5=7, _6=2)
    put("AttributeHierarchy", 1, _1=6, _3=1)
    put("AttributeHierarchyStorage", 1, _9=None)
    put("Column", 30, _1=3, _2="Day", _4=9, _19=1, _18=99)
    put("Measure", 1, _1=1, _2="Total", _3="sum", _5="SUM('Sales'[Amount])", _6="0", _7=0)
    put("Relationship", 1, _3=1, _5=2, _8=1, _9=4, _10=2, _11=3, _12=30, _13=1)
    put("Relationship", 2, _3=0, _5=1, _8=1, _9=4, _10=2, _11=2, _12=30, _13=1)
    put("Role", 1, _2="Some")
    put("Role", 2, _2="None")
    put("TablePermission", 1, _1=1, _2=1, _3="[Name] = 1")
    db.commit()
    return db.serialize()


NAMES = ["alpha", "béta", "", "gamma with words", "x"]
CODES = ["AA", "AB", "C-1", "Ü", "zzz"]


def store_files():
    r = random.Random(3)
    files, want = {store.METADATA: metadata_bytes()}, []
    files |= {"Name.dict": plain_dictionary(NAMES), "Code.dict": huffman_dictionary(CODES), "Amount.dict": number_dictionary([12345, -1, 10**12, 5, 0], 0, 8), "When.dict": number_dictionary([45000.5, 25569.0, 44000.25, 1.0, 0.0], 1, 8), "Flag.dict": number_dictionary([0, 1, -1, 0, 1], 0, 4), "Ratio.dict": number_dictionary([0.5, 1.5, -2.25, 0.0, 9.0], 1, 8)}
    for part, rows in ((0, 1000), (1, 37)):
        ids = {}
        for n in ("Name", "Code", "Amount", "When", "Flag", "Ratio", "Count"):
            own = []
            while len(own) < rows:
                own += [3 + r.randrange(6 if n == "Name" else 5)] * r.choice([1, 1, 2, 3, 40])
            ids[n] = own[:rows]
            files[f"{n}.{part}.idf"], files[f"{n}.{part}.idfmeta"] = column_files(ids[n])
        get = lambda xs, i: xs[i - 3] if i - 3 < len(xs) else None
        for k in range(rows):
            days = get([45000.5, 25569.0, 44000.25, 1.0, 0.0], ids["When"][k])
            want.append(
                (
                    get(NAMES, ids["Name"][k]), get(CODES, ids["Code"][k]), Decimal(get([12345, -1, 10**12, 5, 0], ids["Amount"][k])).scaleb(-4), datetime.datetime(1899, 12, 30) + datetime.timedelta(days=days),
                    get([0, 1, -1, 0, 1], ids["Flag"][k]) != 0, int((ids["Count"][k] + 7) / 2), get([0.5, 1.5, -2.25, 0.0, 9.0], ids["Ratio"][k]),
                )
            )
    return files, want


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 10, 21, 31, 32, 33, 64])
def test_bits(width):
    r = random.Random(width)
    values = [r.randrange(1 << min(width, 62)) for _ in range(200)]
    assert codecs.unpack_bits(np.array(pack(values, width), np.uint64), width, 0)[:200].tolist() == values


def test_segments_and_their_info():
    r = random.Random(9)
    ids = [v for _ in range(300) for v in [r.randrange(5, 300)] * r.choice([1, 1, 2, 5, 30])]
    data, meta = column_files(ids, 5)
    info = codecs.segment_info(meta)
    assert (info.least_id, info.rows) == (5, len(ids))
    two = codecs.segments(data + data)
    assert [codecs.segment_ids(e, w, info).tolist() for e, w in two] == [ids, ids]
    zeros = codecs.segment_ids(np.array([[codecs.PACKED, 4]], "<u4"), np.zeros(1, "<u8"), codecs.SegmentInfo(8, 4, 0, 4))
    assert zeros.tolist() == [8] * 4


def test_dictionaries():
    assert codecs.dictionary(plain_dictionary(NAMES)) == NAMES
    assert codecs.dictionary(huffman_dictionary(CODES)) == CODES
    assert codecs.dictionary(number_dictionary([1, -5], 0, 4)) == [1, -5]
    assert codecs.dictionary(number_dictionary([1 << 60], 0, 8)) == [1 << 60]
    assert codecs.dictionary(number_dictionary([0.25], 1, 8)) == [0.25]
    with pytest.raises(ValueError):
        codecs.dictionary(struct.pack("<i", 7) + bytes(40))


def test_blocks_with_references():
    body = bytes([0b00001000]) + b"abc" + bytes([3, 3])  # three literals, then six bytes from three back
    assert codecs.xpress8_block(body, 9) == b"abcabcabc"
    assert codecs.xpress8_chunks(struct.pack("<II", 9, len(body)) + body + chunked(b"zz")) == b"abcabcabczz"


def test_blocks_with_long_matches():
    for length, tail in ((9, [6]), (10, [7, 0]), (200, [7, 190]), (264, [7, 254]), (5000, [7, 255, 5000 & 255, 5000 >> 8])):
        body = bytes([0b00000010]) + b"a" + bytes([1, tail[0], *tail[1:]])
        assert codecs.xpress8_block(body, length + 1) == b"a" * (length + 1)
    far = bytes(range(256)) * 4
    literals = b"".join(b"\0" + far[k : k + 8] for k in range(0, 1024, 8))
    # back 769: the upper bits in the second byte
    assert codecs.xpress8_block(literals + bytes([1, 1, 3 << 3 | 5]), 1032) == far + far[255:263]
    with pytest.raises(ValueError, match="before"):
        codecs.xpress8_block(bytes([1, 9, 0]), 5)
    assert codecs.xpress8_block(b"\0abc", 9) == b"abc" and codecs.xpress8_block(b"\0abc", 2) == b"ab" and codecs.xpress8_block(b"", 4) == b""


def test_a_segment_that_is_cut_short():
    with pytest.raises(ValueError, match="packed"):
        codecs.segment_ids(np.array([[codecs.PACKED, 9]], "<u4"), np.ones(1, "<u8"), codecs.SegmentInfo(0, 9, 32, 9))


def test_huffman_texts_against_a_bit_at_a_time():
    r = random.Random(4)
    lengths = np.zeros(256, int)
    for k, s in enumerate(b"abcdefgh"):
        lengths[s] = min(k + 1, 7)
    codes = codecs.huffman_codes(lengths)
    of = {s: [c >> n - 1 - k & 1 for k in range(n)] for (n, c), s in codes.items()}
    texts = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(20))) for _ in range(200)]
    bits, begins = [], []
    for t in texts:
        begins.append(len(bits))
        bits += [b for c in t.encode() for b in of[c]]
    ends = [*begins[1:], len(bits)]
    assert codecs.huffman_texts(codes, np.array(bits, np.uint8), np.array(begins), np.array(ends)) == texts
    assert codecs.huffman_texts({}, np.zeros(0, np.uint8), np.zeros(2, int), np.zeros(2, int)) == ["", ""]


def test_a_compressed_model_needs_a_codec():
    data = "This backup was created using XPress9 compression.".encode("utf-16-le").ljust(codecs.SIGNATURE, b"\0") + struct.pack("<II", 5, 5) + b"hello" + struct.pack("<II", 2, 2) + b"!!"
    with pytest.raises(codecs.CodecMissing):
        store.archive_of(data)
    codecs.register_block_codec("test", lambda body, size: body[:size])
    assert codecs.decompress_model(data, "test") == b"hello!!"
    codecs.BLOCK_CODECS.pop("test")


@pytest.mark.parametrize("trimmed, packed, wide", [(False, False, True), (True, False, False), (False, True, True), (True, True, False)])
def test_archive(trimmed, packed, wide):
    files = {"a.idf": b"one", "b.dict": b"two" * 50}
    archive = store.open_archive(archive_bytes(files, trimmed, packed, wide))
    assert {n: archive.read(n) for n in archive.files} == files
    with pytest.raises(ValueError):
        store.open_archive(bytes(5000))


def test_table(spark, tmp_path):
    files, want = store_files()
    path = f"{tmp_path}/model.abf"
    with open(path, "wb") as f:
        f.write(archive_bytes(files))
    spark.dataSource.register(store.StoreSource)
    source = spark.read.format("tabular_store").option("path", path).option("table", "Sales & More").load()
    names = ["Name", "Code", "Amount", "When", "Flag", "Count", "Ratio"]
    assert source.columns == names
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, source.collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, store.read_table(spark, path, "Sales & More").collect()), key=key) == sorted(want, key=key)
    by_uri = spark.read.format("tabular_store").option("path", f"file://{path}").option("table", "Sales & More").load()
    assert by_uri.count() == len(want)
    assert source.filter("Flag").select("Count").count() == sum(w[4] for w in want)
    assert store.table_names(spark, path) == ["Sales & More"]
    with pytest.raises(Exception, match="no table"):
        spark.read.format("tabular_store").option("path", path).option("table", "H$Sales").load().count()


def test_metadata_by_name():
    rows = []
    for named in (False, True):
        db = store.metadata(store.open_archive(archive_bytes({store.METADATA: metadata_bytes(named)})))
        rows.append((store.stored_tables(db), store.model_rows(db, "m")))
    assert rows[0] == rows[1] and len(rows[0][0]["Sales & More"]) == 7


def test_a_missing_dictionary_is_an_error():
    files, _ = store_files()
    del files["Code.dict"]
    archive = store.open_archive(archive_bytes(files))
    column = next(c for c in store.stored_tables(store.metadata(archive))["Sales & More"] if c.name == "Code")
    with pytest.raises(ValueError, match="lacks"):
        store.read_column(archive, column, 0)


def test_packages(spark, tmp_path):
    files, _ = store_files()
    model = {"name": "Zipped", "compatibilityLevel": 1500, "model": {"tables": [{"name": "t", "columns": [{"name": "c"}]}]}}

    def put(name, members):
        with zipfile.ZipFile(f"{tmp_path}/{name}", "w") as z:
            for m, d in members.items():
                z.writestr(m, d)

    put("a.pbit", {"DataModelSchema": "﻿".encode("utf-16-le") + json.dumps(model).encode("utf-16-le")})
    put("b.zip", {"x/Model.bim": json.dumps(model | {"name": "Folder"})})
    put("c.zip", {"d/model.tmdl": "model Docs\n\tculture: de-DE\n", "d/tables/T.tmdl": "table T\n\n\tcolumn c\n\t\tdataType: int64\n"})
    put("d.pbix", {"DataModel": archive_bytes(files)})
    with open(f"{tmp_path}/e.bim", "w") as f:
        json.dump(model | {"name": "Plain"}, f)
    m = package.read_models(spark, [f"{tmp_path}/{n}" for n in ("a.pbit", "b.zip", "c.zip", "d.pbix", "e.bim")])
    got = {r["model_id"][-6:]: (r["name"], r["source_format"]) for r in m.models.collect()}
    assert got == {"a.pbit": ("Zipped", "pbit"), "/b.zip": ("Folder", "bim"), "/c.zip": ("Docs", "tmdl"), "d.pbix": ("Untitled Model", "pbix"), "/e.bim": ("Plain", "bim")}
    tables = sorted((r["model_id"][-6:], r["name"]) for r in m.tables.collect())
    assert tables == [("/b.zip", "t"), ("/c.zip", "T"), ("/e.bim", "t"), ("a.pbit", "t"), ("d.pbix", "Dates"), ("d.pbix", "Sales & More")]
    own = m.relationships.filter("model_id LIKE '%pbix'").collect()
    assert [(r["from_table"], r["from_column"], r["to_table"], r["to_column"], r["cardinality"], r["cross_filter_direction"], r["is_active"]) for r in own] == [("Sales & More", "When", "Dates", "Day", "manyToOne", "both", True)]
    assert [(r["role"], r["table"]) for r in m.role_permissions.filter("model_id LIKE '%pbix'").collect()] == [("Some", "Sales & More")]
    assert m.columns.filter("model_id LIKE '%pbix' AND type = 'calculated'").select("name", "expression").collect() == [("Count", "1 + 1")]
    for name, data in (("x.zip", b"PK\x03\x04 broken"),):
        with pytest.raises(package.UnknownFormat):
            package.sniff(name, data)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("nothing.txt", "")
    with pytest.raises(package.UnknownFormat):
        package.sniff("y.zip", buffer.getvalue())
    assert package.sniff("t.tmdl", b"table T") == "tmdl" and package.sniff("noext", b"{}") == "bim"
