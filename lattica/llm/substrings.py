"""Substring deduplication: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A scan hashes every window. Of the windows of a block of documents that are alike it keeps the earliest; the others
are repeats already. What is left goes, packed by hash range, to one task for each range, which finds the windows that
an earlier document has. The starts of repeats meet their document's text again, where they merge into maximal
intervals and the covered words go. Because a block sends one entry for each distinct window, a passage that a third
of all documents share costs a range one entry for each block, not one for each document.

A block sends at most FAN rows, whatever the size of the input. Where there are more ranges than that, entries go to FAN
groups of ranges first, where parts of many blocks are merged into new blocks and dealt once more; starts of repeats go to
shelves of ids in the same way.

A window is known by 61 bits of one polynomial of its words and 48 of another, at points that are drawn anew for each run
(bytetext): that any two different windows among n are taken for one has a probability below n * n / 2**105.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lattica.llm import staging
from lattica.llm.bytetext import Kit, Words, mix, new_seed, nonspace_bytes, release, slices, string_view, windows

#: Windows in a block of documents within which repeats are found before anything is shuffled.
BLOCK_WORDS = 1_000_000
#: Input bytes for each hash range, and for each shelf of ids; their numbers grow with the input.
RANGE_BYTES, SHELF_BYTES = 8 << 20, 32 << 20
#: Most rows that a block sends.
FAN = 4096
#: Bytes that are kept of a window's second hash.
CHECK = 6
#: Starts of a row of a block's own repeats.
REPEATS = 1 << 16
#: Stands for a null id; it comes before every other.
NO_ID = -(1 << 63)


def levels(parts: int, fan: int) -> list[int]:
    """Upper bits of a hash that tell its part at each level: at most `fan` parts of each part, and at least `parts` in all."""
    bits, step = max(1, (parts - 1).bit_length()), fan.bit_length() - 1
    return [*range(step, bits, step), bits]


def _part(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, deflated: small numbers take about a byte."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unplanes(data: bytes, n: int, kind) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, n)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def pack(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None = None, checks: np.ndarray | None = None, bits: int = 0) -> bytes:
    """Entries in order of (id, start); ids as steps, starts as steps inside an id; of hashes whose part has `bits` bits not the bytes that the part tells."""
    step = np.diff(ids, prepend=np.int64(0))  # wraps, and so does the sum that undoes it
    move = starts.astype(np.int64)
    move[1:] -= np.where(step[1:] == 0, move[:-1], 0)
    a, b = _planes(step), _planes(move.astype(np.int32))
    head = np.array([len(ids), len(a), len(b)], np.int32).tobytes()
    return head + a + b + (hashes.view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8].tobytes() + checks.view(np.uint8).reshape(-1, 8)[:, :CHECK].tobytes() if hashes is not None else b"")


def unpack(data: bytes, hashed: bool, part: int = 0, bits: int = 0):
    """(ids, starts, hashes, checks) of pack()'s entries of a part, the last two None unless hashed."""
    n, la, lb = np.frombuffer(data[:12], np.int32).tolist()
    step = _unplanes(data[12 : 12 + la], n, np.int64)
    move = _unplanes(data[12 + la : 12 + la + lb], n, np.int32).astype(np.int64)
    ids = np.cumsum(step)
    sums = np.cumsum(move)
    fresh = np.ones(n, bool)
    fresh[1:] = step[1:] != 0
    base = (sums - move)[np.flatnonzero(fresh)]
    starts = sums - np.repeat(base, np.diff(np.append(np.flatnonzero(fresh), n)))
    if not hashed:
        return ids, starts.astype(np.int32), None, None
    at = 12 + la + lb
    wide = 8 - bits // 8
    hashes = np.zeros((n, 8), np.uint8)
    hashes[:, :wide] = np.frombuffer(data, np.uint8, wide * n, at).reshape(n, wide)
    hashes = hashes.view(np.uint64).ravel()
    if wide < 8:
        hashes |= np.uint64(int(part) >> bits % 8 << 8 * wide)
    checks = np.zeros((n, 8), np.uint8)
    checks[:, :CHECK] = np.frombuffer(data, np.uint8, CHECK * n, at + wide * n).reshape(n, CHECK)
    return ids, starts.astype(np.int32), hashes, checks.view(np.uint64).ravel()


class _Block:
    """Windows of a block of documents, or of what blocks have sent; out() gives rows (part, fresh, entries)."""

    def __init__(self, bits: int):
        self.bits, self.windows, self.parts = bits, 0, []

    def add(self, ids, starts, hashes, checks):
        self.parts.append((ids, starts, hashes, checks))
        self.windows += len(ids)

    def out(self):
        """Of windows that are alike the earliest, by part of its hash; the starts of the others, as repeats, anywhere among these parts."""
        if not self.windows:
            return
        ids, starts, hashes, checks = (np.concatenate(x) for x in zip(*self.parts))
        self.windows, self.parts = 0, []
        order = np.lexsort((starts, ids))  # nearly sorted as it comes
        ids, starts, hashes, checks = ids[order], starts[order], hashes[order], checks[order]
        by = np.lexsort((checks, hashes))
        like = np.zeros(len(by), bool)
        like[1:] = (hashes[by[1:]] == hashes[by[:-1]]) & (checks[by[1:]] == checks[by[:-1]])
        # rows that share id and start are one place: neither comes before the other
        first = np.maximum.accumulate(np.where(like, 0, np.arange(len(by))))
        later = (ids[by] != ids[by[first]]) | (starts[by] != starts[by[first]])
        repeat, drop = np.zeros(len(by), bool), np.zeros(len(by), bool)
        drop[by[like]] = True
        repeat[by[like & later]] = True
        to = _part(hashes, self.bits)
        repeat = np.flatnonzero(repeat)
        for k in range(0, len(repeat), REPEATS):
            own = repeat[k : k + REPEATS]
            yield int(to[own[0]]), False, pack(ids[own], starts[own])
        keep = np.flatnonzero(~drop)
        keep = keep[np.argsort(to[keep], kind="stable")]
        edges = np.append(np.flatnonzero(np.diff(to[keep], prepend=-1)), len(keep))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = keep[a:b]
            yield int(to[own[0]]), True, pack(ids[own], starts[own], hashes[own], checks[own], self.bits)


def _shelved(ids: np.ndarray, starts: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """(shelf, packed starts) of places, each once."""
    shelf = _part(mix(ids.view(np.uint64)), bits)
    order = np.lexsort((starts, ids, shelf))
    ids, starts, shelf = ids[order], starts[order], shelf[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1])
    ids, starts, shelf = ids[fresh], starts[fresh], shelf[fresh]
    edges = np.append(np.flatnonzero(np.diff(shelf, prepend=-1)), len(shelf)).tolist()
    return [(int(shelf[a]), pack(ids[a:b], starts[a:b])) for a, b in zip(edges[:-1], edges[1:])]


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names)


def repeated_starts(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id long, starts binary), a row for each id that has any: the starts, as 32-bit numbers, of windows whose words also start earlier."""
    size, seed, block_words = staging.plan_bytes(docs), new_seed(), BLOCK_WORDS
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges, shelves = (levels(staging.pieces_for(docs, each), FAN) for each in (RANGE_BYTES, SHELF_BYTES))
    packed_names, packed_kinds = ["part", "fresh", "entries"], [pa.int64(), pa.bool_(), pa.binary()]

    def scan(batches):
        kit, block, inside = Kit(seed), _Block(ranges[0]), nonspace_bytes()
        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, at = string_view(batch.column(1))
            words = Words(raw, at, inside)
            if len(words.start) >= window:
                first, second = (windows(words.hashes(kit, family=f), window, kit, f) for f in range(2))
                ok = np.flatnonzero(words.room()[: len(first)] >= window)
                row = words.row_of_word()[ok]
                block.add(ids[row], (ok - words.first[row]).astype(np.int32), first[ok], second[ok] >> np.uint64(64 - 8 * CHECK))
            if block.windows >= block_words:
                yield _batch(list(block.out()), packed_names, packed_kinds)
                release()
        yield _batch(list(block.out()), packed_names, packed_kinds)

    def deal_again(level: int):
        def run(batches):
            block, more = _Block(ranges[level]), ranges[level] - ranges[level - 1]
            for batch in batches:
                passed = []
                for part, fresh, entries in zip(*(c.to_pylist() for c in batch.columns)):
                    if not fresh:
                        passed.append((part << more | zlib.crc32(entries) % (1 << more), False, entries))
                        continue
                    block.add(*unpack(entries, True, part, ranges[level - 1]))
                    if block.windows >= block_words:
                        passed += block.out()
                yield _batch(passed, packed_names, packed_kinds)
            yield _batch(list(block.out()), packed_names, packed_kinds)
            release()

        return run

    def find(pdf):
        repeats, ids, starts, hashes, checks = [], [], [], [], []
        for part, fresh, entries in zip(pdf["part"], pdf["fresh"], pdf["entries"]):
            i, s, h, c = unpack(entries, fresh, part, ranges[-1])
            if fresh:
                ids.append(i), starts.append(s), hashes.append(h), checks.append(c)
            else:
                repeats.append((i, s))
        if ids:
            hashes = np.concatenate(hashes)
            ordered = np.sort(hashes)
            shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            if len(shared):
                spot = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
                own = np.flatnonzero(shared[spot] == hashes)
                ids, starts, checks, hashes = np.concatenate(ids)[own], np.concatenate(starts)[own], np.concatenate(checks)[own], hashes[own]
                by = np.lexsort((starts, ids, checks, hashes))
                ids, starts, checks, hashes = ids[by], starts[by], checks[by], hashes[by]
                like = np.zeros(len(by), bool)
                like[1:] = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
                first = np.maximum.accumulate(np.where(like, 0, np.arange(len(by))))
                later = (ids != ids[first]) | (starts != starts[first])
                repeats.append((ids[later], starts[later]))
        out = _shelved(*(np.concatenate(x) for x in zip(*repeats)), shelves[0]) if repeats else []
        release()
        return pd.DataFrame({"part": [x[0] for x in out], "entries": [x[1] for x in out]}).astype({"part": np.int64})

    def shelve_again(level: int):
        def run(batches):
            held, count = [], 0
            for batch in batches:
                for entries in batch.column(1).to_pylist():
                    held.append(unpack(entries, False)[:2])
                    count += len(held[-1][0])
                    if count >= block_words:
                        yield _batch(_shelved(*(np.concatenate(x) for x in zip(*held)), shelves[level]), ["part", "entries"], [pa.int64(), pa.binary()])
                        held, count = [], 0
            if held:
                yield _batch(_shelved(*(np.concatenate(x) for x in zip(*held)), shelves[level]), ["part", "entries"], [pa.int64(), pa.binary()])

        return run

    def gather(pdf):
        ids, starts = (np.concatenate(x) for x in zip(*(unpack(e, False)[:2] for e in pdf["entries"])))
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order].astype("<i4")
        cuts = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] ^ 1)), len(ids))
        return pd.DataFrame({"id": ids[cuts[:-1]], "starts": [np.unique(starts[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]})

    def tasks(bits: int) -> int:
        """Four parts to a task, whatever the session's number of shuffle partitions, so a task's share doesn't grow with the input."""
        return min(max(least, (1 << bits) // 4), 1 << 20)

    def dealt(rows: DataFrame, bits: int, each: int) -> DataFrame:
        """Rows of one part in as many tasks as its bytes ask for."""
        parts = 1 << bits
        salts = max(1, -(-size // (parts * each)))
        return rows.withColumn("salt", F.pmod(F.xxhash64("entries"), F.lit(salts))).repartition(min(parts * salts, 1 << 20), "part", "salt").drop("salt")

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = source.mapInArrow(scan, "part long, fresh boolean, entries binary")
    for level in range(1, len(ranges)):
        packed = dealt(packed, ranges[level - 1], RANGE_BYTES).mapInArrow(deal_again(level), "part long, fresh boolean, entries binary")
    found = packed.repartition(tasks(ranges[-1]), "part").groupBy("part").applyInPandas(find, "part long, entries binary")
    for level in range(1, len(shelves)):
        found = dealt(found, shelves[level - 1], SHELF_BYTES).mapInArrow(shelve_again(level), "part long, entries binary")
    return found.repartition(tasks(shelves[-1]), "part").groupBy("part").applyInPandas(gather, "id long, starts binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(id, n_words, n_removed, intervals array<struct<start, end>>, kept), one row for each row of docs.

    Removed is each word covered by a window of `window` words whose word sequence also starts earlier (smaller id, or
    the same id and an earlier start), judged on the input; intervals are maximal, in words, end exclusive; kept holds
    the other words, unchanged, joined by one space. Null and empty texts have no words. Rows that share an id are one
    document in the order: equal starts don't remove each other, and a start found for the id holds for each of its
    rows, as far as the row's words go. A null id comes first. Ids are whole numbers; others raise a TypeError before
    anything runs. Other columns of docs are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of a whole-number type, not {docs.schema[id_col].dataType.simpleString()}")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    source = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    # written, so that the shuffle of windows is freed before the texts are shuffled
    starts = staging.written(repeated_starts(docs, id_col, text_col, window)).withColumnRenamed("id", "key")
    joined = source.join(starts, "key", "left").select("id", "text", "starts")

    def cut(batches):
        inside = nonspace_bytes()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            raw, at = string_view(batch.column(1))
            words = Words(raw, at, inside)
            n_removed, spans, kept = [], [], []
            for row, found in enumerate(batch.column(2).to_pylist()):
                a, n = int(words.first[row]), int(words.counts[row])
                step = np.zeros(n + 1, np.int32)
                if found:
                    s = np.unique(np.frombuffer(found, "<i4"))
                    s = s[s + window <= n]
                    step[s] += 1
                    step[s + window] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                n_removed.append(int(gone.sum()))
                stay = a + np.flatnonzero(~gone)
                # the bytes of kept words and one byte after each: a space, whatever stands there
                mark = np.zeros(int(at[row + 1] - at[row]) + 2, np.int32)
                np.add.at(mark, words.start[stay] - at[row], 1)
                np.add.at(mark, words.end[stay] - at[row] + 1, -1)
                body = np.append(raw[at[row] : at[row + 1]], np.uint8(32))
                body[words.end[stay] - at[row]] = 32
                kept.append(body[np.cumsum(mark[:-1]) > 0].tobytes()[:-1].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "intervals", "kept"])

    interval = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("intervals", interval), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The contract's rule in DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20
), h AS (
  SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 20], ' ')) AS h FROM s
), r AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM h) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r
), p AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d
), k AS (
  SELECT p.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (gone.p IS NULL) AS kept
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY p.doc_id
)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
