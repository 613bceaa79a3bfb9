import random
import re

import numpy as np
import pytest

from lattica.llm import components, ngramjoin


def brute(rows, k, num, den):
    """(set size, least id reachable) of each row, by comparing all pairs."""
    sets = []
    for i, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                label[top(a)] = top(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return sorted((-1 if i is None else i, len(sets[x]), -1 if i is None else least[top(x)]) for x, (i, _) in enumerate(rows))


def some_rows(seed, families, copies, length, edits):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    rows, i = [], 0
    passage = [r.choice(vocabulary) for _ in range(12)]
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randrange(1, length))] + passage * (r.random() < 0.3)
        for _ in range(r.randrange(1, copies)):
            own = list(base)
            for _ in range(r.randrange(edits)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            if r.random() < 0.3:
                own += [r.choice(vocabulary) for _ in range(r.randrange(4))]
            rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in own)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, num, den, block, common", [(3, 90, 100, 1024, None), (3, 90, 100, 3, 1000), (5, 80, 100, 1024, 1000), (2, 80, 100, 4, 1000), (5, 80, 100, 4, None)])
def test_against_all_pairs(spark, monkeypatch, k, num, den, block, common):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "BLOCK_BITMAPS", 8192 if block == 1024 else 5)
    monkeypatch.setattr(ngramjoin, "COMMON_LEAST", 16 if block == 1024 else 2)
    rows = some_rows(k + num + block, 25, 12, 150, 5) + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one"), (906, "x y z"), (906, "completely different words here now"), (907, "Completely different words here now")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, k1 int").repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component"] is None else r["component"]) for r in ngramjoin.near_groups(df, words=k, num=num, den=den, common=common).collect())
    assert got == brute(rows, k, num, den)
    assert len({c for *_, c in got}) < len(got) - 10


def test_sets_with_too_few_parts(spark, monkeypatch):
    rows = some_rows(7, 12, 8, 60, 3)
    real = ngramjoin.part_keys

    def lame(*a):
        row, band, keys, whole = real(*a)
        return row, band, [k[:0] for k in keys], np.zeros(len(whole), bool)

    monkeypatch.setattr(ngramjoin, "part_keys", lame)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngramjoin.near_groups(df, words=3, num=90, den=100).collect())
    assert got == brute(rows, 3, 90, 100)


def test_large_group_whose_copies_are_not_alike(spark, monkeypatch):
    # a star: copies differ from the first text a little, from each other too much
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(100):
        own = list(base)
        for p in r.sample(range(3, 197), 3):
            own[p] = f"n{i}x{p}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in ngramjoin.near_groups(df, words=3, num=90, den=100).collect())
    assert got == brute(rows, 3, 90, 100)
    assert {c for *_, c in got} == {0}


def pairs_around_texts_without_ids():
    """Pairs of copies of a text; it and most other copies occur only without an id, so they are likely roots of parts."""
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(None, " ".join(base))] * 2
    for i in range(440):
        own = list(base)
        for p in r.sample(range(3, 197), 3):
            own[p] = f"n{i}x{p}"
        if i < 400:
            rows.append((None, " ".join(own)))
            continue
        rows.append((2 * i, " ".join(own)))
        own[r.randrange(3, 197)] = f"m{i}"
        rows.append((2 * i + 1, " ".join(own)))
    return rows


def test_large_group_whose_centre_has_no_id(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    rows = pairs_around_texts_without_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((-1 if i is None else i, n, -1 if c is None else c) for i, n, c in ngramjoin.near_groups(df, words=3, num=90, den=100).collect())
    want = brute(rows, 3, 90, 100)
    assert got == want
    assert sum(i != c for i, _, c in want) >= 40


def test_empty(spark):
    assert ngramjoin.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets_agree_in_a_part():
    r = np.random.default_rng(3)
    for num in (80, 90):
        for n in (4, 9, 10, 11, 25, 47, 48, 130, 700):
            for _ in range(40):
                x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
                gone = int(r.integers(0, n * (100 - num) // num + 1))
                y = np.unique(np.concatenate([x[gone // 2 :], r.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)]))
                if not ngramjoin.similar(x, y, num, 100) or len(x) == len(y) and (x == y).all():
                    continue
                both = np.concatenate([x, y])
                for share in (0, 2, 5, 8, 9, 10):  # tenths of all shingles that are common
                    row, band, keys, whole = ngramjoin.part_keys(both, np.array([0, len(x), len(x) + len(y)]), num, 100, both % np.uint64(10) < share)
                    assert whole.all()
                    a = {(b, k) for w, b, ks in zip(row, band, keys) if w == 0 for k in ks.tolist()}
                    b = {(b, k) for w, b, ks in zip(row, band, keys) if w == 1 for k in ks.tolist()}
                    assert a & b


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)] + [(None, 4), (7, 7)]
    got = {x["node"]: x["least"] for x in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    change = True
    while change:
        change = False
        for a, b in edges:
            if a in label and b in label and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                change = True
    assert got == label
    assert components.connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_words_that_polynomials_modulo_2_to_the_64_confuse(spark):
    rows = []
    for size in (1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") & 1] for k in range(size))
        other = word.translate(str.maketrans("ab", "ba"))
        rows += [(len(rows), word), (len(rows) + 1, other), (len(rows) + 2, word), (len(rows) + 3, f"x y {word}"), (len(rows) + 4, f"x y {other}")]
    got = ngramjoin.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, den=100).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 90, 100)


def test_a_chain_of_copies_with_a_few_apart(spark, monkeypatch):
    # most of the chain is one star; the rest meets all blocks, and some of it is similar to sets of other blocks only
    monkeypatch.setattr(ngramjoin, "BLOCK_BITMAPS", 8)
    r = random.Random(12)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    for _ in range(45):
        own = list(base)
        own[r.randrange(200)] = f"x{len(rows)}"
        add(own)
    for k in range(6):
        add(base[: 100 + 10 * k] + [f"y{k} {j}" for j in range(60)])  # parts in common, but not similar
    step = list(base)
    for k in range(8):  # each similar to the one before it
        step[5 + 20 * k : 8 + 20 * k] = [f"z{k}", f"z{k}a", f"z{k}b"]
        add(step)
    r.shuffle(rows)
    got = ngramjoin.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=3, num=90, den=100).collect()
    want = brute(rows, 3, 90, 100)
    assert sorted(map(tuple, got)) == want
    assert len({c for *_, c in want}) > 3


def test_only_sets_that_meet_are_compared(monkeypatch):
    """A chain of sets in which each agrees with the next one only: comparisons grow with its length, not with the square."""
    n, compared = 400, []
    size, bits = np.full(n, 100, np.int64), np.zeros((n, 2), np.uint64)
    meets = [np.array([k, k + 1], np.int64) for k in range(n)]
    count = np.bitwise_count
    monkeypatch.setattr(ngramjoin.np, "bitwise_count", lambda x: compared.append(len(x)) or count(x))
    found = ngramjoin.links(size, bits, None, np.arange(n), None, [], 80, 100, meets)
    assert sorted(tuple(sorted(p)) for p in found) == [(k, k + 1) for k in range(n - 1)]
    assert sum(compared) < 2 * n
    # sets that are alike but don't meet aren't linked; those in one meeting of all are
    assert ngramjoin.links(size, bits, None, np.arange(n), None, [], 80, 100, [m[:1] for m in meets]) == []
    assert len(ngramjoin.links(size, bits, None, np.arange(n), None, [], 80, 100, [np.zeros(1, np.int64)] * n)) == n - 1
