import random

import numpy as np
import pytest

from lattica.llm import substrings


def brute(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def some_docs():
    r = random.Random(1)
    shared = [[r.choice("ab") + r.choice("xyé") for _ in range(r.randrange(3, 30))] for _ in range(8)]
    docs = []
    for k in range(80):
        words = []
        for _ in range(r.randrange(0, 6)):
            words += r.choice(shared) if r.random() < 0.6 else [str(r.random()) for _ in range(r.randrange(8))]
        docs.append((k, " \t".join(words)))
    return docs + [(200, None), (201, ""), (202, " "), (203, "same " * 50), (204, docs[5][1])]


def test_against_brute_force(spark, monkeypatch):
    docs = some_docs()
    df = spark.createDataFrame(random.Random(2).sample(docs, len(docs)), "doc_id long, text string").repartition(5)
    # blocks of 40 windows; three levels of ranges and shelves; rows of few repeats
    for small in ({}, {"BLOCK_WORDS": 40}, {"BLOCK_WORDS": 40, "FAN": 4, "RANGE_BYTES": 1200, "SHELF_BYTES": 1200, "REPEATS": 5}):
        for name, value in small.items():
            monkeypatch.setattr(substrings, name, value)
        got = {r["doc_id"]: r for r in substrings.remove_repeats(df, window=6).collect()}
        want = brute(docs, 6)
        assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in got.items()} == want
        assert all(sum(x["end"] - x["start"] for x in r["intervals"]) == r["n_removed"] for r in got.values())


def test_pack_round_trip():
    ids = np.array([-(1 << 63), -5, -5, 3, 3, 3, 1 << 62], np.int64)
    starts = np.array([7, 0, 9, 1, 2, 100000, 4], np.int32)
    hashes, checks = np.arange(7, dtype=np.uint64), np.arange(7, 14, dtype=np.uint64) << np.uint64(40)
    for bits in (0, 1, 8, 11, 16, 22):
        known = hashes | np.uint64(0x123456789ABCDEF0 >> 64 - bits << 64 - bits if bits else 0)
        part = int(known[0]) >> 64 - bits if bits else 0
        a, b, c, d = substrings.unpack(substrings.pack(ids, starts, known, checks, bits), True, part, bits)
        assert (a == ids).all() and (b == starts).all() and (c == known).all() and (d == checks).all()


def test_edges(spark):
    text = " ".join(map(str, range(25)))
    df = spark.createDataFrame([(None, text, 1), (1, text, 2), (1, text, 2), (2, "x " + text, 3)], "doc_id long, text string, starts int")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 0), (1, 25), (1, 25), (2, 25)]
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.remove_repeats(twice).collect()] == [0, 0]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_words_that_polynomials_modulo_2_to_the_64_confuse(spark):
    tail = " ".join(map(str, range(19)))
    docs = []
    for size in (1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") & 1] for k in range(size))
        docs += [(len(docs), f"{word} {tail}"), (len(docs) + 1, f"{word.translate(str.maketrans('ab', 'ba'))} {tail}"), (len(docs) + 2, f"{word} {tail}")]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: n for i, (_, n, _) in brute(docs, 20).items()} and sorted(got.values()) == [0] * 6 + [20] * 3


def test_what_a_block_sends_does_not_grow_with_the_ranges():
    r = np.random.default_rng(1)
    n = 1_000_000
    ids, starts = np.arange(n // 400).repeat(400), np.tile(np.arange(400, dtype=np.int32), n // 400)
    hashes, checks = r.integers(0, 1 << 64, n, np.uint64), r.integers(0, 1 << 48, n, np.uint64)
    sent = {}
    for ranges in (16, 333_333, 10_000_000):
        block = substrings._Block(substrings.levels(ranges, substrings.FAN)[0])
        block.add(ids, starts, hashes, checks)
        rows = list(block.out())
        assert len(rows) <= substrings.FAN
        sent[ranges] = sum(len(x) for *_, x in rows)
    assert max(sent.values()) < 1.05 * min(sent.values()), sent


def test_ids_that_are_no_numbers(spark):
    with pytest.raises(TypeError, match="whole-number"):
        substrings.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
