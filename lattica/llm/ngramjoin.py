"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

Two sets of x <= y shingles whose Jaccard similarity is at least num/den differ in at most x * (den - num) / num shingles.
In a size band all sets are cut into the same number of parts, more than that; so two similar sets agree in whole parts,
and one of the first few that aren't empty is among them. The parts hold the rarer shingles, as far as these suffice. Sets that agree in a part are candidates; chains of candidates
in a band are compared by hashed bitmaps: the bits in which two differ bound the overlap from above. What the bitmaps
leave connected makes a tile; only sets in tiles of two or more are looked at again. In a tile, pairs that the bitmaps
don't rule out, and that aren't connected already, are decided by intersecting the sorted arrays. Large tiles are dealt
to blocks: each block also has the tile's pivot, the set that shares parts with the most others, and what isn't connected
to the pivot afterwards meets all other blocks, a block at a time.

Equal sets are one class from the start, whatever their number, and no list of pairs is made. Nothing is capped.

Shingles are known by 61-bit hashes whose points are drawn anew for each run, classes by two keys that come from hashes at
different points. Two given sets of n shingles are taken for nearer than they are with a probability below n * n / 2**56.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm import components, decontam, staging
from lattica.llm.bytetext import U64, Kit, Words, mix, new_seed, nonspace_bytes, slices, string_view, windows

#: Bitmaps in a block of a tile; sets in a block of a tile, and shingles.
BLOCK_BITMAPS, BLOCK, BLOCK_SHINGLES = 8192, 4096, 2_000_000
#: Rows of small chains that are looked at together.
GROUPED = 2048
#: Parts of a band for each part that its largest sets need: of all shingles, and of the rarer ones; and so many more.
SPARE, SPARE_RARE, SPARE_LEAST = 1.15, 2.6, 8
#: Bands of sets no larger than this have a part for each shingle: few shingles in few parts would too often meet in one.
SMALL = 32
#: A common shingle is in so many texts at least. Counts are approximate: they come from blocks of COMMON_BLOCK shingles; of a shingle that a block has less than COMMON_SEEN times, the block says nothing.
COMMON_LEAST, COMMON_SEEN, COMMON_BLOCK = 16, 2, 4_000_000
#: Bits of the map of common shingles: 2 MB, whatever the corpus.
COMMON_BITS = 24
#: Most and least bits of a bitmap; bits for each shingle of a band's largest sets.
BITS_MOST, BITS_LEAST, BITS_EACH = 1 << 16, 64, 2


def band_starts(most: int = 1 << 40) -> np.ndarray:
    """The least size of each band: 1, 2, 3, 4, 6, 9, ..., each half as large again."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


def needed(size, num: int, den: int):
    """Parts of which one must agree: one more than the shingles in which a similar set of no fewer can differ."""
    return size * (den - num) // num + 1


class Shingler:
    """Sets of hashed shingles of the texts of a piece; all tasks of a run share the seed."""

    def __init__(self, words: int, seed: int):
        self.words, self.kit, self.inside = words, Kit(seed), nonspace_bytes()

    def sets(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): the ascending distinct hashes of text k lie in hashes[bounds[k]:bounds[k + 1]]."""
        return self.sets_and_keys(texts, False)[:2]

    def sets_and_keys(self, texts, keyed: bool = True):
        """sets() and two 64-bit keys of each set, the second from hashes of the shingles at other points."""
        raw, at = string_view(texts)
        words = Words(raw, at, self.inside)
        hashed = [words.hashes(self.kit, fold=True, family=f) for f in range(1 + keyed)]
        grams = [windows(h, self.words, self.kit, f) for f, h in enumerate(hashed)]
        out, others = [], []
        for a, n in zip(words.first[:-1].tolist(), words.counts.tolist()):
            if n >= self.words:
                own, first = np.unique(grams[0][a : a + n - self.words + 1], return_index=True)
                out.append(own)
                if keyed:
                    others.append(grams[1][a : a + n - self.words + 1][first])
            elif n:
                out.append(windows(hashed[0][a : a + n], n, self.kit))
                if keyed:
                    others.append(windows(hashed[1][a : a + n], n, self.kit, 1))
            else:
                out.append(np.zeros(0, U64))
        hashes = np.concatenate(out) if out else np.zeros(0, U64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        if not keyed:
            return hashes, bounds
        others = np.concatenate(others) if others else np.zeros(0, U64)
        return hashes, bounds, class_key(hashes, bounds, 11), class_key(others, bounds, 12)


def _wrapping_sums(place: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit numbers by place, modulo 2**64; halves add up exactly as doubles."""
    low = np.bincount(place, (x & U64(0xFFFFFFFF)).astype(np.float64), size).astype(U64)
    high = np.bincount(place, (x >> U64(32)).astype(np.float64), size).astype(U64)
    return low + (high << U64(32))


def class_key(hashes: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key of each set, whatever the order of its hashes."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    size = np.diff(bounds).astype(U64)
    return mix(_wrapping_sums(row, mix(hashes + U64(salt)), len(bounds) - 1) + size).astype(np.int64)


def _parts_of(most: np.ndarray, spare: float, need_most: np.ndarray) -> np.ndarray:
    """Parts of bands whose largest sets have `most` shingles and need `need_most` parts; 0 stands for a part for each shingle."""
    return np.where(most <= SMALL, 0, np.ceil(need_most * spare).astype(np.int64) + SPARE_LEAST)


def _first_parts(element: np.ndarray, entry: np.ndarray, band: np.ndarray, parts: np.ndarray, need: np.ndarray, salt: int):
    """(owner, key) of the first `need` parts that aren't empty of each entry, and how many there are in all; element and entry run along the sets' hashes."""
    turned = mix(element + ((band[entry].astype(U64) + U64(1)) << U64(40)) + U64(salt))
    mark = (U64(salt) << U64(56)) + (band.astype(U64) << U64(32))
    # small sets: a part is a shingle, in the order of the turned hashes
    own = np.flatnonzero(parts[entry] == 0)
    own = own[np.lexsort((turned[own], entry[own]))]
    count = np.bincount(entry[own], minlength=len(parts))
    rank = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    own = own[rank < need[entry[own]]]
    small_owner, small_keys = entry[own], mix(turned[own] + mark[entry[own]])
    # others: parts by hash
    offset = np.concatenate([[0], np.cumsum(parts)])
    own = np.flatnonzero(parts[entry] > 0)
    place = offset[entry[own]] + (turned[own] % np.maximum(parts[entry[own]], 1).astype(U64)).astype(np.int64)
    sums = _wrapping_sums(place, mix(turned[own]), offset[-1])
    full = np.bincount(place, minlength=offset[-1]) > 0
    owner = np.repeat(np.arange(len(parts)), parts)
    before = np.concatenate([[0], np.cumsum(full)])
    used = full & (before[1:] - before[offset[:-1]][owner] <= need[owner])
    number = np.arange(offset[-1]) - offset[owner]
    keys = mix(sums + mix(mark[owner] + number.astype(U64)))[used]
    owner, keys = np.concatenate([owner[used], small_owner]), np.concatenate([keys, small_keys])
    order = np.argsort(owner, kind="stable")
    return owner[order], keys[order].astype(np.int64), before[offset[1:]] - before[offset[:-1]] + count


def part_keys(hashes: np.ndarray, bounds: np.ndarray, num: int, den: int, common: np.ndarray):
    """(row, band, keys, whole): for sets that can have a similar other, the keys of the parts to compare in each band.

    Parts hold the rarer shingles only, so that a passage which many texts share brings none of them together. A set with
    too few such parts, or one that may be similar to such a set, is cut once more with all its shingles. `common` says
    which hashes are common; any rule that goes by the hash alone gives complete results. whole is False for a set that
    has too few parts even so; then its keys don't suffice.
    """
    starts, size = band_starts(), np.diff(bounds)
    band = np.searchsorted(starts, np.maximum(size, 1), "right") - 1
    live = np.flatnonzero(needed(size, num, den) > 1)
    guest = live[size[live] * den >= starts[band[live] + 1] * num]  # may be similar to one in the next band
    row = np.concatenate([live, guest])
    band = np.concatenate([band[live], band[guest] + 1])
    if not len(row):
        return row, band, [], np.zeros(0, bool)
    need, most = needed(size[row], num, den), needed(starts[band + 1] - 1, num, den)

    def elements(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = size[rows]
        spot = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return spot, np.repeat(np.arange(len(rows)), count)

    spot, entry = elements(row)
    rare = ~common[spot]
    owner, keys, full = _first_parts(hashes[spot[rare]], entry[rare], band, _parts_of(starts[band + 1] - 1, SPARE_RARE, most), need, 1)
    enough = full >= need
    owner, keys = owner[enough[owner]], keys[enough[owner]]
    # a set similar to one that hasn't enough has less than twice as many as it needs
    again = np.flatnonzero(full < 2 * need)
    whole = np.ones(len(row), bool)
    if len(again):
        spot, entry = elements(row[again])
        more, more_keys, full = _first_parts(hashes[spot], entry, band[again], _parts_of(starts[band[again] + 1] - 1, SPARE, most[again]), need[again], 2)
        whole[again] = full >= need[again]
        owner, keys = np.concatenate([owner, again[more]]), np.concatenate([keys, more_keys])
        order = np.argsort(owner, kind="stable")
        owner, keys = owner[order], keys[order]
    return row, band, np.split(keys, np.searchsorted(owner, np.arange(1, len(row)))), whole


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending arrays of distinct hashes are similar enough."""
    if len(a) > len(b):
        a, b = b, a
    spot = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[spot] == a))
    return den * both >= num * (len(a) + len(b) - both)


def bitmap(hashes: np.ndarray, most: int) -> bytes:
    """A bit for each shingle, in a bitmap whose length goes by the largest size of the band."""
    bits = BITS_LEAST
    while bits < BITS_MOST and bits < BITS_EACH * most:
        bits *= 2
    out = np.zeros(bits, bool)
    out[(hashes % U64(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _meetings(meets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, spots, members): set i is in the meetings spots[at[i]:at[i + 1]], and meeting s has the sets members[s[0]:s[1]]."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in meets])]).astype(np.int64)
    _, name = np.unique(np.concatenate([np.zeros(0, np.int64), *meets]), return_inverse=True)
    order = np.argsort(name, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(name))]).astype(np.int64)
    return at, np.stack([ends[name], ends[name + 1]], axis=1), np.repeat(np.arange(len(meets)), np.diff(at))[order]


def links(size: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None, group: np.ndarray, side: np.ndarray | None, first: list[int], num: int, den: int, meets=None) -> list[tuple[int, int]]:
    """Pairs that connect all that similar pairs connect; without sets, all that the bitmaps don't rule out.

    group: sets of the same number are connected already. side: where given, only pairs of different sides count.
    first: sets that are compared with all others before the rest. meets: where given, an array of numbers for each set;
    only pairs that have one in common need to be compared.
    """
    group, out = group.copy(), []
    if meets is not None:
        at, spots, members = _meetings(meets)
    order = np.argsort(size, kind="stable")
    ranked = size[order]
    done = np.zeros(len(size), bool)
    ahead = set(first)
    for i in [*first, *(k for k in order.tolist() if k not in ahead)]:
        low = np.searchsorted(ranked, -(-size[i] * num // den), "left")
        high = np.searchsorted(ranked, size[i] * den // num, "right")
        near = order[low:high]
        if meets is not None:
            own = spots[at[i] : at[i + 1]]
            # several large meetings of the same sets may name more sets than there are
            if (own[:, 1] - own[:, 0]).sum() < len(near):
                near = np.unique(np.concatenate([members[a:b] for a, b in own.tolist()] or [near[:0]]))
                near = near[(size[near] >= -(-size[i] * num // den)) & (size[near] <= size[i] * den // num)]
        near = near[(group[near] != group[i]) & ~done[near]]
        if side is not None:
            near = near[side[near] != side[i]]
        done[i] = True
        if not len(near):
            continue
        differ = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
        bound = (size[near] + size[i] - differ) // 2  # each bit that differs is a shingle of one set only
        near = near[den * bound >= num * (size[near] + size[i] - bound)]
        for j in near.tolist():
            if group[j] != group[i] and (sets is None or similar(sets[i], sets[j], num, den)):
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def _bit_rows(bits) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def _refine_rows(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Pairs of nodes that connect what the bitmaps of a block, or of two, don't rule out."""
    pdf = pdf.drop_duplicates("node")
    node, block = pdf["node"].to_numpy(), pdf["block"].to_numpy()
    side = block if pdf["low"].iloc[0] != pdf["high"].iloc[0] else None
    meets = [np.asarray(x, np.int64) for x in pdf["meets"]]
    found = links(pdf["n"].to_numpy(np.int64), _bit_rows(pdf["bits"].tolist()), None, np.arange(len(pdf)), side, [], num, den, meets)
    return pd.DataFrame({"a": node[[i for i, _ in found]], "b": node[[j for _, j in found]]})


def _link_rows(pdf: pd.DataFrame, num: int, den: int, crossed: bool) -> pd.DataFrame:
    """Pairs of ids that connect what similar sets of a block, or of two, connect."""
    pdf = pdf.drop_duplicates(["id", "k1", "k2"] + (["side"] if crossed else []))
    sets = [np.frombuffer(x, "<u8") for x in pdf["hashes"]]
    size, ids = np.array([len(x) for x in sets], np.int64), pdf["id"].to_numpy()
    bits = _bit_rows([bitmap(x, int(size.max())) for x in sets])
    if crossed:
        _, group = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        found = links(size, bits, sets, group, pdf["side"].to_numpy(), [], num, den)
    else:
        found = links(size, bits, sets, np.arange(len(sets)), None, np.flatnonzero(pdf["pivot"].to_numpy()).tolist(), num, den)
    return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}).astype({"a": pdf["id"].dtype, "b": pdf["id"].dtype})


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, common: int | None = None) -> DataFrame:
    """(id, n_shingles, component), one row for each row of docs.

    A-Z is lower-cased; words are `[^\\x20\\x09-\\x0D]+`; a set holds the distinct shingles of `words` words, or the whole
    sequence where there are fewer. Sets are linked when den * intersection >= num * union; component is the least id
    reachable by links, the row's own included. Null and empty texts and texts without words have an empty set and are
    linked with nothing. Rows that share an id are one document: they share a component. A null id takes no part in
    linking and has a null component. Other columns of docs are not read.

    common changes the work, not the result: where it is given, shingles that one in so many texts has are kept out of
    the parts, which pays where parts are small, that is at low similarities.
    """
    assert 3 * num >= 2 * den, "bands are half as large again: two similar sets must lie in one or in neighbours"
    with staging.scope(docs.sparkSession):
        return _near_groups(docs, id_col, text_col, words, num, den, common)


def _near_groups(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, common: int | None) -> DataFrame:
    """What near_groups() returns; all but two of the tables that it writes are read only while it runs."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["id"]
    seed = new_seed()

    commons = spark.sparkContext.broadcast(_common(source, words, common, seed) if common else None)

    def scan(batches):
        shingler, seen = Shingler(words, seed), set()
        is_common = decontam.tester(commons.value, COMMON_BITS) if commons.value is not None else lambda x: np.ones(len(x), bool)
        bands = pa.list_(pa.struct([("band", pa.int32()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())]))
        starts = band_starts()
        for batch in slices(batches):
            hashes, bounds, k1, k2 = shingler.sets_and_keys(batch.column(1))
            row, band, keys, whole = part_keys(hashes, bounds, num, den, is_common(hashes))
            told = [[] for _ in range(batch.num_rows)]
            short = np.zeros(batch.num_rows, bool)
            if len(seen) > 500_000:
                seen.clear()
            # a task tells the parts of equal sets once; those of rows without an id never, so that each node has a class and each tile its pivot
            fresh = [known and x not in seen and not seen.add(x) for known, x in zip(batch.column(0).is_valid().to_pylist(), k1.tolist())]
            for r, b, k, w in zip(row.tolist(), band.tolist(), keys, whole.tolist()):
                short[r] |= not w
                if fresh[r]:
                    told[r].append({"band": b, "keys": k, "bits": bitmap(hashes[bounds[r] : bounds[r + 1]], int(starts[b + 1]))})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(k1), pa.array(k2), pa.array(short), pa.array(told, bands)], ["id", "n", "k1", "k2", "short", "bands"])

    def sized(batches):
        """Sets of the documents that are wanted, with the tiles that want them."""
        shingler = Shingler(words, seed)
        for batch in slices(batches):
            hashes, bounds, k1, k2 = shingler.sets_and_keys(batch.column(1))
            out = {"id": [], "k1": [], "k2": [], "n": [], "tile": [], "blocks": [], "pivot": [], "hashes": []}
            ids = batch.column(0).to_pylist()
            for r, wanted in enumerate(batch.column(2).to_pylist()):
                for w in wanted:
                    if w["k1"] == k1[r] and w["k2"] == k2[r]:
                        out["id"].append(ids[r])
                        out["n"].append(int(bounds[r + 1] - bounds[r]))
                        out["hashes"].append(hashes[bounds[r] : bounds[r + 1]].tobytes())
                        for c in ("k1", "k2", "tile", "blocks", "pivot"):
                            out[c].append(w[c])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", batch.schema.field(0).type), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("tile", pa.int64()), ("blocks", pa.int64()), ("pivot", pa.bool_()), ("hashes", pa.binary())]))

    parts_path = staging.shared_folder(spark)
    staging.write(source.mapInArrow(scan, f"id {kind}, n long, k1 long, k2 long, short boolean, bands array<struct<band:int, keys:array<long>, bits:binary>>"), parts_path)
    scanned = spark.read.parquet(parts_path)
    info = staging.written(scanned.select("id", "n", "k1", "k2", "short"), keep=True)

    # sets of a band that agree in a part: each points at the least of them
    node = F.xxhash64("k1", "band").alias("node")
    banded = scanned.select("k1", F.col("n").cast("int").alias("n"), F.explode("bands").alias("b")).select("n", "k1", F.col("b.band").alias("band"), "b.keys", "b.bits")
    keys = banded.select(node, "n", F.explode("keys").alias("key"))
    # ends are aggregated before they are shuffled; written, their shuffle is freed before the join, whose tasks for a key
    # with very many sets can be split: they are merged, not broadcast, as the driver's memory is no measure of theirs
    # keys that the same sets have are one meeting; a meeting of others with the same name only costs comparisons
    meeting = F.xxhash64("root", "top", "rows", "mark").alias("meeting")
    told = keys.groupBy("key").agg(F.min("node").alias("root"), F.max("node").alias("top"), F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("node")).alias("mark"))
    ends = staging.written(told.filter("root <> top").select("key", "root", meeting, (F.col("rows") > BLOCK_BITMAPS).alias("large")))
    met = keys.join(ends.hint("merge"), "key")
    met = staging.written(met.groupBy("node", "root", "large").agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n"), F.collect_set("meeting").alias("meets")))

    # chains of candidates; sets that meet are compared, and what the bitmaps rule out isn't linked
    paired = _paired(met, banded.select(node, "n", "bits"))
    refined = staging.written(paired.groupBy(F.length("bits"), "least", "low", "high").applyInPandas(lambda _, pdf: _refine_rows(pdf, num, den), "a long, b long"))
    staging.drop_folder(spark, parts_path)
    tiles = components.connected(refined, "a", "b")
    weight = met.groupBy("node").agg(F.sum("met").alias("met"), F.max("n").alias("n"))
    # a root has met as many as point at it
    rooted = met.groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("pointed"))
    weighed = tiles.join(weight, "node", "left").join(rooted, "node", "left").withColumn("weight", F.struct((F.coalesce("met", F.lit(0)) + F.coalesce("pointed", F.lit(0))).alias("w"), "node"))
    heads = weighed.groupBy("least").agg(F.count(F.lit(1)).alias("sets"), F.max("weight")["node"].alias("pivot_node"), F.sum("n").alias("shingles"))
    heads = staging.written(heads.withColumn("blocks", F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("shingles") / BLOCK_SHINGLES))).drop("shingles"))
    placed = tiles.join(heads, "least").select("node", F.col("least").alias("tile"), "blocks", (F.col("node") == F.col("pivot_node")).alias("pivot"))

    classes = staging.written(info.filter("id IS NOT NULL AND n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.max("short").alias("short")))
    starts = F.array(*map(F.lit, band_starts(1 << 30).tolist()))
    own = F.size(F.filter(starts, lambda s: s <= F.col("n"))) - 1
    placeable = classes.withColumn("band", F.explode(F.array(own, own + 1))).withColumn("node", F.xxhash64("k1", F.col("band").cast("int")))
    listed = placeable.join(placed, "node").groupBy("id").agg(F.collect_list(F.struct("k1", "k2", "tile", "blocks", "pivot")).alias("wanted"))
    sets = staging.written(source.join(listed, "id").select("id", "text", "wanted").mapInArrow(sized, f"id {kind}, k1 long, k2 long, n long, tile long, blocks long, pivot boolean, hashes binary"))

    edge_type = f"a {kind}, b {kind}"
    inner = staging.written(sets.filter("blocks = 1").groupBy("tile").applyInPandas(lambda pdf: _link_rows(pdf, num, den, False), edge_type))
    if heads.filter("blocks > 1").limit(1).count():
        # a large tile's blocks, each with the pivot
        large = sets.filter("blocks > 1")
        block = F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("k2"), F.col("blocks"))))
        inner = inner.unionByName(staging.written(large.withColumn("block", F.explode(block)).groupBy("tile", "block").applyInPandas(lambda pdf: _link_rows(pdf, num, den, False), edge_type)))
        # what isn't connected to the pivot then meets the other blocks
        label = components.connected(inner, "a", "b")
        named = large.join(label, large["id"] == label["node"], "left").select(*(large[c] for c in large.columns), F.coalesce("least", large["id"]).alias("label"))
        pivots = named.filter("pivot").select("tile", F.col("label").alias("pivot_label")).distinct()
        apart = named.join(pivots, "tile").withColumn("apart", F.col("label") != F.col("pivot_label"))
        lone = apart.filter("apart").groupBy("tile").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("lone_blocks"))
        crossed = apart.join(lone, "tile")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = crossed.filter("apart").withColumn("row", F.pmod(F.xxhash64("k1"), F.col("lone_blocks"))).withColumn("col", every("blocks")).withColumn("side", F.lit(0))
        right = crossed.withColumn("col", F.pmod(F.xxhash64("k2"), F.col("blocks"))).withColumn("row", every("lone_blocks")).withColumn("side", F.lit(1))
        inner = inner.unionByName(staging.written(left.unionByName(right).groupBy("tile", "row", "col").applyInPandas(lambda pdf: _link_rows(pdf, num, den, True), edge_type)))
    # a set whose parts are too few, which chance all but rules out, meets all sets that may be similar
    short = classes.filter("short")
    if short.limit(1).count():
        inner = inner.unionByName(staging.written(_meet_all(source, classes, words, num, den, kind, seed)))
    # rows that share an id are one document
    same = info.select("id", "k1", "k2", "n").filter("id IS NOT NULL AND n > 0").join(classes.select("k1", "k2", "n", F.col("id").alias("head")), ["k1", "k2", "n"])
    several = same.groupBy("id").agg(F.min("head").alias("a"), F.max("head").alias("b")).filter("a <> b")
    extra = same.join(several.select("id", "a"), "id").select(F.col("a"), F.col("head").alias("b"))
    label = components.connected(inner.unionByName(extra), "a", "b")

    heads = staging.written(classes.join(label, classes["id"] == label["node"], "left").select("k1", "k2", "n", F.coalesce("least", "id").alias("component")), keep=True)
    out = info.join(heads, ["k1", "k2", "n"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast(kind)).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component"))


def _paired(met: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows of nodes for _refine_rows: every two nodes that share a meeting are together in the rows of some (least, low, high).

    Bitmaps of one length are compared. Chains of up to BLOCK_BITMAPS nodes are rows of one block. Larger ones are dealt by meeting, some BLOCK_BITMAPS rows
    to a block, so chains that chance agreements join aren't compared in whole. Nodes that meetings of more rows join
    are compared in whole, in blocks.
    """
    each = met.filter("not large").groupBy("node").agg(F.flatten(F.collect_list("meets")).alias("meets"))
    chains = components.connected(met.filter("not large"), "node", "root")
    dealt = each.join(chains, "node")
    rows = F.sum(F.size("meets"))
    counts = F.when(F.count(F.lit(1)) <= BLOCK_BITMAPS, 1).otherwise(F.ceil(rows / BLOCK_BITMAPS))
    sizes = staging.written(dealt.groupBy("least").agg(counts.cast("long").alias("blocks")))
    spots = F.transform("meets", lambda m: F.struct(F.pmod(F.xxhash64(m), F.col("blocks")).alias("low"), m.alias("meet")))
    # a group of rows costs as much as many comparisons: chains of one block share groups, some GROUPED rows to each
    shared = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("least"), F.lit(-(-each.count() // GROUPED) or 1))).otherwise(F.col("least")).alias("least")
    dealt = dealt.join(sizes, "least").select(shared, "node", F.explode(spots).alias("s"))
    dealt = dealt.groupBy("least", "node", F.col("s.low").alias("low")).agg(F.collect_list("s.meet").alias("meets"))
    out = bitmaps.join(dealt, "node").select("least", "low", F.col("low").alias("high"), F.col("low").alias("block"), "node", "n", "bits", "meets")
    large = met.filter("large")
    if not large.limit(1).count():
        return out
    chains = components.connected(large, "node", "root")
    sizes = staging.written(chains.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / BLOCK_BITMAPS).alias("blocks")))
    marked = bitmaps.join(chains, "node").join(sizes, "least").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # numbers under 0, so that these blocks aren't those of the chain above whose least node is the same
    marked = marked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    marked = marked.withColumn("block", -1 - F.col("block")).withColumn("other", -1 - F.col("other"))
    return out.unionByName(marked.select("least", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "bits", F.array("least").alias("meets")))


def _meet_all(source: DataFrame, classes: DataFrame, words: int, num: int, den: int, kind: str, seed: int) -> DataFrame:
    """Edges of the sets whose parts are too few with all other sets, in blocks."""

    def sized(batches):
        shingler = Shingler(words, seed)
        for batch in slices(batches):
            hashes, bounds, k1, k2 = shingler.sets_and_keys(batch.column(1))
            own = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1), pa.array(k2), pa.array(own, pa.binary())], ["id", "k1", "k2", "hashes"])

    blocks = staging.pieces_for(source, 4 << 20)
    sets = source.filter("id IS NOT NULL").mapInArrow(sized, f"id {kind}, k1 long, k2 long, hashes binary").filter("length(hashes) > 0").withColumn("label", F.col("id"))
    few = sets.join(classes.filter("short").select("k1", "k2"), ["k1", "k2"], "left_semi")
    left = few.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    right = sets.withColumn("col", F.pmod(F.xxhash64("k2"), F.lit(blocks)).cast("int")).withColumn("side", F.lit(1))
    return left.unionByName(right).groupBy("col").applyInPandas(lambda pdf: _link_rows(pdf, num, den, True), f"a {kind}, b {kind}")


def _common(source: DataFrame, words: int, share: int, seed: int) -> bytes:
    """A bitmap of the shingles that about one in `share` texts has; what a block sees less than COMMON_SEEN times isn't counted. part_keys is complete for any such map."""

    def count(batches):
        shingler = Shingler(words, seed)

        def frequent(kept):
            ordered = np.sort(np.concatenate(kept)) if kept else np.zeros(0, U64)
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(ordered)))
            often = n >= COMMON_SEEN
            return pa.RecordBatch.from_arrays([pa.array(ordered[first[often]].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

        kept, size = [], 0
        for batch in slices(batches):
            hashes, _ = shingler.sets(batch.column(1))
            kept.append(hashes)
            size += len(hashes)
            if size >= COMMON_BLOCK:
                yield frequent(kept)
                kept, size = [], 0
        yield frequent(kept)

    least = max(COMMON_LEAST, source.count() // share)
    seen = source.select("id", "text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return decontam.bitmap(seen.filter(F.col("n") >= least).select("h"), COMMON_BITS)


#: The contract's rule in DuckDB SQL (three words, 90 of 100).
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i + 1 : i + 3], ' ') FOR i IN range(len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, spot) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, t.b FROM r JOIN both_ways t ON r.spot = t.a
)
SELECT d.doc_id, cast(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.spot) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
