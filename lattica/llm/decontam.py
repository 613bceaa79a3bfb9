"""Benchmark decontamination by winnowing.

Of every `window - gram + 1` consecutive gram hashes the smallest is kept, in items and documents alike, so two texts
that share `window` words share a kept hash. A document's kept hashes are tested against a bitmap of bounded size that
holds the items' kept hashes; around each hit the match is extended to the whole windows that may hold it, and these
are joined with the items' windows on their words. Only windows around hits leave the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lattica.llm import staging
from lattica.llm.bytetext import Kit, Words, alnum_bytes, lowered, slices, string_view, windows as window_hashes

#: Least and most bits, as powers of two, of the two bitmaps of item hashes, and bits for each item window: 2 to 32 MB each.
#: Beyond 16 million windows more of the documents' windows pass the bitmaps and are left to the join.
BITMAP_BITS, BITMAP_MOST, BITMAP_EACH = 24, 28, 16
#: Parts into which the documents' windows of one word sequence are dealt, and copies of each item window: SALTS at least, one
#: for each SALT_BYTES of documents, SALTS_MOST at most.
SALTS, SALT_BYTES, SALTS_MOST = 16, 1 << 30, 1024


def winnowed(hashes: np.ndarray, span: int) -> np.ndarray:
    """Whether each hash is the smallest of some `span` consecutive ones."""
    kept = np.zeros(len(hashes), bool)
    if len(hashes) >= span:
        least = np.lib.stride_tricks.sliding_window_view(hashes, span).min(axis=1)
        for k in range(span):
            kept[k : k + len(least)] |= hashes[k : k + len(least)] == least
    return kept


def _hashed_words(kit, raw, at):
    """(words, their hashes, room): of each word of a piece also how many words of its text start there or later."""
    words = Words(raw, at, alnum_bytes())
    return words, words.hashes(kit, fold=True), words.room()


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(item, size, key, words, print): each item's windows of `window` words, or its one shorter window; print holds the kept gram hashes in it."""

    def run(batches):
        kit = Kit()
        for batch in slices(batches):
            raw, at = string_view(batch.column(1))
            words, hashed, room = _hashed_words(kit, raw, at)
            small = lowered()[raw]
            kept = winnowed(window_hashes(hashed, gram, kit), window - gram + 1)
            grams = window_hashes(hashed, gram, kit)
            out = {"item": [], "size": [], "key": [], "words": [], "print": []}
            ids = batch.column(0).to_pylist()
            for row, (a, n) in enumerate(zip(words.first[:-1].tolist(), words.counts.tolist())):
                size = min(n, window)
                for s in range(a, a + n - size + 1) if n else ():
                    out["item"].append(ids[row])
                    out["size"].append(size)
                    out["key"].append(int(window_hashes(hashed[s : s + size], size, kit)[0].astype(np.int64)))
                    out["words"].append(b" ".join(bytes(small[words.start[w] : words.end[w]]) for w in range(s, s + size)).decode())
                    out["print"].append([int(x) for x in grams[s : s + window - gram + 1][kept[s : s + window - gram + 1]].astype(np.int64)] if size == window else [])
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["size"], pa.int32()), pa.array(out["key"], pa.int64()), pa.array(out["words"], pa.string()), pa.array(out["print"], pa.list_(pa.int64()))], list(out))

    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "item string, size int, key long, words string, print array<long>")


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> bytes:
    """A bitmap of 2**bits bits in which the top bits of each hash in the column `h` are set; its size is fixed."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    rows = (
        hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def tester(data: bytes, bits: int):
    """A test of 64-bit hashes against a bitmap."""
    words = np.frombuffer(data, np.uint64)

    def test(hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - bits)
        return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    return test


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, gram: int = 5, share: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_hit, n_items, items array<string>, contaminated) and the columns in `carry`, one row for each row of docs.

    A document word inside any occurrence of an item's window is hit; contaminated: share * n_hit >= n_words and n_hit > 0.
    Null and empty texts have no words: as a document nothing is hit, as an item there is no window. Items shorter than
    `window` lie below winnowing's guarantee; documents are searched for them at every position. Rows that share an id are
    judged each on its own. A null item id counts as the empty string. An empty table of items hits nothing.
    Columns of docs other than those named are dropped, so their names can't clash.
    """
    spark = docs.sparkSession
    windows = staging.written(item_windows(items, item_id, item_text, window, gram))
    full = windows.filter(F.col("size") == window)
    by_size = {r["size"]: r["count"] for r in windows.groupBy("size").count().collect()}  # at most `window` sizes
    bits = min(max((BITMAP_EACH * sum(by_size.values())).bit_length(), BITMAP_BITS), BITMAP_MOST)
    prints = spark.sparkContext.broadcast(bitmap(full.select(F.explode("print").alias("h")), bits))
    keys = spark.sparkContext.broadcast(bitmap(windows.select(F.col("key").alias("h")), bits))
    sizes, span = sorted(n for n in by_size if n < window), window - gram + 1
    salts = min(staging.pieces_for(docs, SALT_BYTES, SALTS), SALTS_MOST)

    def scan(batches):
        kit = Kit()
        small = lowered()
        has_print, has_key = tester(prints.value, bits), tester(keys.value, bits)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("words", pa.string())]))
        for batch in slices(batches):
            raw, at = string_view(batch.column(1))
            words, hashed, room = _hashed_words(kit, raw, at)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            row_of, total = None, len(hashed)
            candidates = []
            grams = window_hashes(hashed, gram, kit)
            if total >= window:
                # winnowing over the joined stream keeps, inside each text, at least what it keeps of the text alone
                hit = np.flatnonzero(winnowed(grams, span) & has_print(grams))
                if len(hit):
                    starts = np.unique((hit[:, None] - np.arange(span)[None, :]).ravel())
                    starts = starts[(starts >= 0) & (starts <= total - window)]
                    candidates.append((window, starts[room[starts] >= window]))
            for size in sizes:
                if total >= size:
                    candidates.append((size, np.flatnonzero(room[: total - size + 1] >= size)))
            for size, starts in candidates:
                if not len(starts):
                    continue
                all_keys = window_hashes(hashed, size, kit)
                starts = starts[has_key(all_keys[starts])]
                if len(starts) and row_of is None:
                    row_of = words.row_of_word()
                for s in starts.tolist():
                    row = int(row_of[s])
                    text = b" ".join(small[raw[words.start[w] : words.end[w]]].tobytes() for w in range(s, s + size)).decode()
                    hits[row].append({"at": s - int(words.first[row]), "size": size, "key": int(all_keys[s].astype(np.int64)), "words": text})
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != 1), pa.array(words.counts, pa.int64()), pa.array(hits, kind)], [*(f for k, f in enumerate(batch.schema.names) if k != 1), "n_words", "hits"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), *(F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)))
    hit_type = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("words", T.StringType())]))
    schema = T.StructType([f for f in source.schema if f.name != "body"] + [T.StructField("n_words", T.LongType()), T.StructField("hits", hit_type)])
    found = staging.written(source.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id()))

    # a passage that very many documents hold is dealt to many tasks
    seen = found.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    listed = windows.select("item", "key", "words").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    once = listed.select("key", "words", "salt").distinct()
    places = seen.join(once, ["key", "words", "salt"], "left_semi").groupBy("row", "at").agg(F.max(F.col("at") + F.col("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    hit = (
        places.withColumn("before", F.coalesce(before, F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("at", "before"))).cast("long").alias("n_hit"))
    )
    named = seen.select("row", "key", "words", "salt").distinct().join(listed, ["key", "words", "salt"]).select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    judged = found.drop("hits").join(hit, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    empty = F.array().cast("array<string>")
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", empty)).cast("long").alias("n_items"),
        F.coalesce("items", empty).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        *(F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)),
    )


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


#: The contract's rule in DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS s FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS words FROM bs
), sizes AS (SELECT DISTINCT n FROM bw),
ds AS (
  SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n
), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS words FROM ds
), m AS (
  SELECT dw.doc_id, dw.n, dw.s, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.words = bw.words
), spots AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""
