"""A content-addressed store of token ids.

Texts become id streams with an end id. A rolling hash over the ids cuts each stream where the content says so, so equal
passages give equal chunks; each distinct chunk is stored once under its SHA-256. A document's recipe lists its chunks.
Recipes lie in files in ascending order of document id; each file's manifest holds the root of a Merkle tree over its
recipes, and the store's root is taken over the files' roots. Readers check every chunk against its name.

Layout of a store: raw/kind=chunk (name, body: ids as little-endian unsigned 16- or 32-bit numbers), recipes/ (part,
row, doc, n_tokens, names: 32 bytes each), manifest/ (part, rows, tokens, root).
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lattica.llm import staging
from lattica.llm.bytetext import Kit, Powers, gram_hashes, lanes, mix, padded, prefix_sums, slices, string_view

#: Ids that the rolling hash sees; one in MEAN ids ends a chunk; no chunk is longer than LONGEST.
ROLL, MEAN, LONGEST = 16, 256, 4096
#: Text pieces whose ids a Python worker remembers before it starts anew: about 25 MB.
REMEMBERED = 480_000
#: Text bytes that are encoded at a time.
ENCODED = 1 << 18
#: Bytes of remembered pieces over 16 bytes, after which it also starts anew.
HELD = 32 << 20
#: Chunk names that a task remembers, so that it sends a chunk's ids once.
SENT = 200_000


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

    The tokenizer's own split never joins characters over certain places: between ASCII letters (or two-byte letters of
    U+00C0 to U+00FF), digits and signs of different kinds, before white space that follows one of these, before a
    space that one of these follows, and after a lone line break between two of them; not after an apostrophe. Cut
    there, a piece has the same ids alone as in its text. Texts that hold a string of an added token, or no such place,
    go through the library whole. A piece is known by its bytes: up to 16 as two numbers and a length, longer ones by their
    place in a dictionary; hashes of these only find the row where they are compared.
    """

    def __init__(self, file: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(file), dtype
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each piece comes once; its own cache only costs
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.breaker = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # kinds of bytes: 1 letter, 2 digit, 3 sign, 4 space, 5 line break, 6 other white space, 0 not known
        kind = np.zeros(256, np.uint8)
        kind[33:127], kind[48:58], kind[65:91], kind[97:123] = 3, 2, 1, 1
        kind[32], kind[10], kind[[9, 11, 12, 13]] = 4, 5, 6
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending keys, and where a piece's row is
        self.names, self.lengths = np.zeros((3, 1024), np.uint64), np.zeros(1024, np.int64)
        self.starts, self.flat, self.filled = np.zeros(1024, np.int64), np.zeros(1 << 16, self.dtype), 0
        self.long, self.held = {}, 0  # numbers of pieces over 16 bytes, and how many bytes they have

    def named(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Three numbers for each piece, which tell its bytes from all others'."""
        size = ends - starts
        body = padded(raw)
        out = np.stack([lanes(body, starts, size, 8), lanes(body, starts + 8, np.maximum(size - 8, 0), 8), size.astype(np.uint64)])
        out[1, size <= 8] = 0
        for k in np.flatnonzero(size > 16).tolist():
            piece = raw[starts[k] : ends[k]].tobytes()
            number = self.long.get(piece)
            if number is None:
                number = self.long[piece] = len(self.long)
                self.held += len(piece)
            out[:, k] = number, 0, 17
        return out

    def borders(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of pieces: of each text with bytes, and of the places above."""
        n = len(raw)
        kind = self.kind[raw]
        # a two-byte letter is led by C3; its signs are C3 97 and C3 B7
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        plain = (kind >= 1) & (kind <= 3)
        out = np.zeros(n, bool)
        before, now = kind[:-1], kind[1:]
        out[1:] = plain[:-1] & plain[1:] & (before != now) & (raw[:-1] != 39)
        out[1:] |= plain[:-1] & (now >= 4)
        out[:-1] |= (kind[:-1] == 4) & plain[1:]
        if n > 2:
            out[2:] |= plain[:-2] & (kind[1:-1] == 5) & plain[2:]
        out[at[:-1][at[:-1] < at[1:]]] = True
        return np.flatnonzero(out)

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, names: np.ndarray) -> None:
        """Encode new pieces. Those without white space but for a first space stand in one text with line breaks between them, which stay tokens of their own."""
        base, new = len(self.keys), len(starts)
        while len(self.lengths) < base + new:
            self.names, self.lengths, self.starts = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.names, self.lengths, self.starts))
        self.names[:, base : base + new] = names
        body = raw.tobytes()
        pieces = [body[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        odd = re.compile(rb".[\t-\r ]|[\t-\r\x1c-\x1f\xc2\xe1-\xe3]", re.S).search
        easy = [k for k, p in enumerate(pieces) if not odd(p) and p != b" "] if len(self.breaker) == 1 else []
        hard = sorted(set(range(new)) - set(easy))
        for k in range(0, len(easy), 2048):
            own = easy[k : k + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces[i].decode() for i in own)], add_special_tokens=False)[0].ids, np.int64)
            ends_at = np.append(np.flatnonzero(ids == self.breaker[0]), len(ids))
            if len(ends_at) != len(own):
                hard += own
                continue
            starts_at = np.append(0, ends_at[:-1] + 1)
            where = base + np.array(own)
            self.lengths[where] = ends_at - starts_at
            self.starts[where] = self.filled + np.cumsum(ends_at - starts_at) - (ends_at - starts_at)
            self._append(ids[ids != self.breaker[0]])
        for k in range(0, len(hard), 2048):
            own = hard[k : k + 2048]
            for i, e in zip(own, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in own], add_special_tokens=False)):
                self.lengths[base + i], self.starts[base + i] = len(e.ids), self.filled
                self._append(np.array(e.ids, np.int64))
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.places = np.insert(self.keys, spot, keys), np.insert(self.places, spot, base + np.arange(new))

    def _append(self, ids: np.ndarray) -> None:
        while len(self.flat) < self.filled + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text of an Arrow string array; null is the empty text."""
        raw, at = string_view(texts)
        body = raw.tobytes()
        if any(x in body for x in self.added):
            out = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return [np.array(e.ids, self.dtype) for e in out]
        if not len(raw):
            return [np.zeros(0, self.dtype)] * len(texts)
        if len(self.keys) > REMEMBERED or self.held > HELD:
            self.clear()
        starts = self.borders(raw, at)
        ends = np.append(starts[1:], len(raw))
        names = self.named(raw, starts, ends)
        keys, first, place = np.unique(mix(names[0] ^ mix(names[1] ^ mix(names[2] + np.uint64(1)))), return_index=True, return_inverse=True)
        index = np.full(len(keys), -1)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            index = np.where(self.keys[spot] == keys, self.places[spot], -1)
        new = np.flatnonzero(index < 0)
        if len(new):
            index[new] = len(self.keys) + np.arange(len(new))
            self._learn(raw, starts[first[new]], ends[first[new]], keys[new], names[:, first[new]])
        if (self.names[:, index][:, place] != names).any():  # two pieces with one key
            self.clear()
            out = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return [np.array(e.ids, self.dtype) for e in out]
        own = index[place]
        counts = self.lengths[own]
        sums = prefix_sums(counts)
        ids = self.flat[np.repeat(self.starts[own] - sums[:-1], counts) + np.arange(sums[-1])]
        bounds = sums[np.searchsorted(starts, at)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def cuts(ids: np.ndarray, at: np.ndarray, powers: Powers) -> list[list[int]]:
    """Ends of the chunks of each id stream ids[at[k]:at[k + 1]], from its start: where the hash of the last ROLL ids says so, LONGEST ids after the last end, and at the stream's end."""
    with np.errstate(over="ignore"):
        rolled = gram_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), ROLL, powers)
    ends = np.flatnonzero(rolled % np.uint64(MEAN) == 0) + ROLL
    low = np.searchsorted(ends, at[:-1] + ROLL)
    high = np.searchsorted(ends, at[1:])
    out = []
    for k, n in enumerate(np.diff(at).tolist()):
        own, last = [], 0
        for end in [*(ends[low[k] : high[k]] - at[k]).tolist(), n]:
            while end - last > LONGEST:
                last += LONGEST
                own.append(last)
            if end > last:
                own.append(end)
                last = end
        out.append(own)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary SHA-256 tree; an odd node moves up as it is; no leaves: 32 zero bytes."""
    if not leaves:
        return bytes(32)
    while len(leaves) > 1:
        leaves = [hashlib.sha256(leaves[k] + leaves[k + 1]).digest() if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, vocabulary: int = 1 << 16, carry: tuple[str, ...] = ()) -> None:
    """Write the store of docs' texts at path, an unused folder that driver and executors share.

    Null and empty texts are the end id alone. Rows that share an id have a recipe each, in the order of their texts'
    chunk names. A null id comes first. Columns in `carry` lie in the recipes; others are not read.
    """
    spark = docs.sparkSession
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def scan(batches):
        # a worker runs one task after another: the next one goes on with what this one knows
        worker = sys.modules.setdefault("lattica_worker", types.ModuleType("lattica_worker")).__dict__
        encoder = worker.pop((tokenizer, dtype), None) or Encoder(tokenizer, dtype)
        end = np.array([end_id], dtype).tobytes()
        wide = np.dtype(dtype).itemsize
        powers = Kit().gram
        sent: set[bytes] = set()
        for batch in slices(batches, ENCODED):
            streams = [x.tobytes() + end for x in encoder.encode(batch.column(1))]
            bounds = np.concatenate([[0], np.cumsum([len(x) // wide for x in streams])])
            stops = cuts(np.frombuffer(b"".join(streams), dtype), bounds, powers)
            rows, counts, names = [], [], []
            chunk_names, chunk_ids = [], []
            if len(sent) > SENT:
                sent.clear()
            for row, stream in enumerate(streams):
                at, own = 0, []
                for stop in stops[row]:
                    part = stream[at * wide : stop * wide]
                    name = hashlib.sha256(part).digest()
                    own.append(name)
                    if name not in sent:
                        sent.add(name)
                        chunk_names.append(name)
                        chunk_ids.append(part)
                    at = stop
                rows.append(row)
                counts.append(len(stream) // wide)
                names.append(b"".join(own))
            n, m = len(rows), len(chunk_names)
            # rows of two kinds: recipes have an id and n_tokens, chunks a name
            own = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for k, c in enumerate(batch.columns) if k != 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *own,
                    pa.array(counts + [None] * m, pa.int64()),
                    pa.array([None] * n + chunk_names, pa.binary()),
                    pa.array(names + chunk_ids, pa.binary()),
                ],
                [*(f for k, f in enumerate(batch.schema.names) if k != 1), "n_tokens", "name", "body"],
            )
        worker[tokenizer, dtype] = encoder

    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "text") + ", n_tokens long, name binary, body binary"
    rows = source.mapInArrow(scan, schema)
    # recipes go anywhere (those of one id needn't meet), chunks by their name: one job, one shuffle, each chunk kept once
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), staging.pieces_for(docs, 32 << 20, 1))
    dealt = rows.repartition(pieces, F.coalesce("name", F.xxhash64("doc", "body").cast("string").cast("binary")))

    def once(batches):
        seen: set[bytes] = set()
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("name")).to_pylist()
            keep = []
            for name in names:
                keep.append(name is None or name not in seen)
                if name is not None:
                    seen.add(name)
            yield batch.filter(pa.array(keep, pa.bool_()))

    raw = f"{path}/raw"
    kinds = dealt.mapInArrow(once, schema).withColumn("kind", F.when(F.col("name").isNull(), "recipe").otherwise("chunk"))
    staging.write(kinds, raw, partition_by="kind")
    both = spark.read.schema(kinds.schema).parquet(raw)
    # recipes are small: into ascending order of id, numbered by file
    recipes = both.filter("kind = 'recipe'").drop("kind", "name")
    order = [F.col("doc").asc_nulls_first(), F.col("body")]
    parts = recipes.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    staging.write(parts.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).withColumnRenamed("body", "names"), f"{path}/recipes")
    staging.drop_folder(spark, f"{raw}/kind=recipe")

    staging.write(_roots(spark, path), f"{path}/manifest")


def _roots(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows as the recipe files give them: (part, rows, tokens, root)."""

    def roots(pdf):
        import pandas as pd

        pdf = pdf.sort_values("row")
        leaves = [hashlib.sha256(f"{d}:{n}:".encode() + bytes(x)).digest() for d, n, x in zip(pdf["doc_text"], pdf["n_tokens"], pdf["names"])]
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "rows": [len(pdf)], "tokens": [int(pdf["n_tokens"].sum())], "root": [merkle(leaves)]})

    kept = spark.read.parquet(f"{path}/recipes")
    told = kept.select("part", "row", F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("doc_text"), "n_tokens", "names")
    return told.groupBy("part").applyInPandas(roots, "part int, rows long, tokens long, root binary")


def verify(spark: SparkSession, path: str) -> None:
    """Raise unless the recipes give the manifest's roots again."""
    told = spark.read.parquet(f"{path}/manifest")
    again = _roots(spark, path).select("part", *(F.col(c).alias(f"{c}_again") for c in ("rows", "tokens", "root")))
    same = F.lit(True)
    for c in ("rows", "tokens", "root"):
        same &= F.col(c).eqNullSafe(F.col(f"{c}_again"))
    wrong = told.join(again, "part", "full").filter(~same).count()
    if wrong:
        raise ValueError(f"{wrong} recipe files don't fit the manifest")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name binary, body binary, kind string").parquet(f"{path}/raw").filter("kind = 'chunk'").select("name", F.col("body").alias("ids"))


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, doc, n_tokens, names and what was carried): the documents in ascending order of part and row."""
    return spark.read.parquet(f"{path}/recipes")


def root(spark: SparkSession, path: str) -> str:
    """The store's Merkle root: over the files' roots, of which there are as many as recipe files."""
    rows = spark.read.parquet(f"{path}/manifest").select("part", "root").collect()
    return merkle([bytes(r["root"]) for r in sorted(rows, key=lambda r: r["part"])]).hex()


def reconstruct(spark: SparkSession, path: str, vocabulary: int = 1 << 16) -> DataFrame:
    """(doc, row, ids array<int>): every document's ids from the files; a chunk that its name doesn't fit ends the run."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def checked(batches):
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if hashlib.sha256(ids).digest() != name:
                    raise ValueError(f"chunk {name.hex()} doesn't hold what its name says")
            yield batch

    def joined(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), dtype).astype(np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc", "row", "ids"])

    chunks = _chunks(spark, path).mapInArrow(checked, "name binary, ids binary")
    own = recipes(spark, path).select("doc", "row", F.posexplode(_names()).alias("at", "name"))
    told = own.join(chunks, "name").groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    kind = dict(told.dtypes)["doc"]
    return told.mapInArrow(joined, f"doc {kind}, row long, ids array<int>")


def _names() -> F.Column:
    """The 32-byte names of a recipe."""
    return F.expr("transform(sequence(0, cast(length(names) / 32 as int) - 1), i -> substring(names, i * 32 + 1, 32))")


def starts(found: DataFrame) -> DataFrame:
    """found (part, row, n_tokens, ...) with start: the ids of all documents before it. The sum over files runs over one row for each file."""
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    offset = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("offset"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return found.withColumn("inside", inside).join(offset, "part").withColumn("start", F.col("offset") + F.col("inside")).drop("inside", "offset")


def digests(spark: SparkSession, path: str, vocabulary: int = 1 << 16) -> DataFrame:
    """(doc, row, part, n_tokens, ids_crc32 and what was carried) of each document, from the files.

    Each stored chunk is read, checked against its name and reduced to its length and the CRC-32 of its ids as 32-bit
    numbers. A document's CRC-32 follows from those of its chunks in the recipe's order, so no ids are shuffled. A
    recipe whose chunks are missing or don't add up to its n_tokens ends the run.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def reduced(batches):
        wide = np.dtype(dtype).itemsize
        for batch in batches:
            names, body = batch.column(0).cast(pa.large_binary()), batch.column(1).cast(pa.large_binary())
            at = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
            raw = memoryview(body.buffers()[2])[at[0] : at[-1]] if len(body) else b""
            at = at - at[0] if len(body) else at
            full = memoryview(np.frombuffer(raw, dtype).astype("<u4")).cast("B")
            told, crc = names.to_pylist(), []
            for name, a, b in zip(told, at[:-1].tolist(), at[1:].tolist()):
                if hashlib.sha256(raw[a:b]).digest() != name:
                    raise ValueError(f"chunk {name.hex()} doesn't hold what its name says")
                crc.append(zlib.crc32(full[4 * a // wide : 4 * b // wide]))
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.binary()), pa.array(np.diff(at) // wide, pa.int64()), pa.array(crc, pa.int64())], ["name", "n", "crc"])

    def combined(batches):
        shift = CrcShift()
        for batch in batches:
            parts = batch.column(batch.schema.get_field_index("parts"))
            want = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy(zero_copy_only=False)
            ends = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
            own = parts.values
            n, crc = (own.field(k).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for k in (1, 2))
            ends = ends - ends[0]
            sums = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            if (sums[ends[1:]] - sums[ends[:-1]] != want).any():
                raise ValueError("a recipe's chunks don't add up to its ids")
            # what a chunk adds to its document's sum depends on how many bytes follow it there
            after = np.repeat(sums[ends[1:]], np.diff(ends)) - sums[1:]
            added = np.concatenate([[0], np.bitwise_xor.accumulate(shift.shifted(crc.astype(np.int64), 4 * after))]).astype(np.int64)
            value = added[ends[1:]] ^ added[ends[:-1]]
            keep = [k for k, f in enumerate(batch.schema.names) if f != "parts"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(value, pa.int64())], [*(batch.schema.names[k] for k in keep), "ids_crc32"])

    chunks = _chunks(spark, path).mapInArrow(reduced, "name binary, n long, crc long")
    kept = recipes(spark, path)
    own = kept.select("row", F.posexplode(_names()).alias("at", "name"))
    told = own.join(chunks, "name").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    full = kept.drop("names").join(told, "row", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<at:int,n:bigint,crc:bigint>>")))
    schema = ", ".join(f"{c} {dict(full.dtypes)[c]}" for c in full.columns if c != "parts") + ", ids_crc32 long"
    return full.mapInArrow(combined, schema)


class CrcShift:
    """CRC-32 of joined bytes from the parts': the first value is carried over as many zero bytes as the second part has."""

    POLY = 0xEDB88320

    def __init__(self):
        # matrices over GF(2) as 32 columns: one zero bit, squared three times for one zero byte
        self.matrix = [self.POLY] + [1 << k for k in range(31)]
        for _ in range(3):
            self.matrix = [self._apply(self.matrix, c) for c in self.matrix]
        self.tables: list[list[list[int]]] = []  # for 1, 2, 4, ... zero bytes: a table for each byte of the value

    @staticmethod
    def _apply(matrix: list[int], x: int) -> int:
        out, k = 0, 0
        while x:
            if x & 1:
                out ^= matrix[k]
            x >>= 1
            k += 1
        return out

    def _grow(self) -> None:
        own = []
        for byte in range(4):
            t = [0] * 256
            for i in range(8):
                for j in range(1 << i):
                    t[(1 << i) + j] = t[j] ^ self.matrix[8 * byte + i]
            own.append(t)
        self.tables.append(own)
        self.matrix = [self._apply(self.matrix, c) for c in self.matrix]

    def shifted(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each value carried over as many zero bytes."""
        values, k = values.copy(), 0
        while (sizes >> k).any():
            if len(self.tables) <= k:
                self._grow()
            own = np.flatnonzero(sizes >> k & 1)
            a, b, c, d = (np.array(t, np.int64) for t in self.tables[k])
            x = values[own]
            values[own] = a[x & 255] ^ b[x >> 8 & 255] ^ c[x >> 16 & 255] ^ d[x >> 24]
            k += 1
        return values

    def combine(self, first: int, second: int, size: int) -> int:
        return int(self.shifted(np.array([first], np.int64), np.array([size], np.int64))[0]) ^ second
