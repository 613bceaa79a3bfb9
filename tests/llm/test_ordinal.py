import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import contract, ordinal

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ratings = ordinal.ratings_of(spark.read.parquet(f"{SF}/labels.parquet"))
    model = ordinal.fit(docs, ratings.filter("doc_id % 4 <> 0"), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    rows = docs.join(ratings.filter("doc_id % 4 = 0"), "doc_id").select("grade", ordinal.graded(docs, model).alias("g")).collect()
    kept = lambda k: np.mean([r["g"]["tail"] >= ordinal.SELECT for r in rows if r["grade"] == k])
    assert kept(2) > 0.99 and kept(0) < 0.1 and kept(1) < 0.4
    mean = lambda k: np.mean([r["g"]["expected"] for r in rows if r["grade"] == k])
    assert mean(0) < mean(1) < mean(2)


def test_piece_bounds_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = ordinal.Model(np.linspace(-1, 1, 1 << ordinal.BITS), np.array([-1.0, 0.5]))
    score = lambda df: {r["doc_id"]: round(r["g"]["expected"], 9) for r in df.select("doc_id", ordinal.graded(df, model).alias("g")).collect()}
    assert score(docs) == score(docs.repartition(7))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "good text", "y"), (2, "", "z"), (2, "bad " * 50000, "z")], "doc_id long, text string, grade string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = ordinal.fit(df, none, 3)
    assert [round(r["g"]["tail"], 3) for r in df.select(ordinal.graded(df, model).alias("g")).collect()] == [1.0] * 4
    one = spark.createDataFrame([(2, 0), (2, 2), (None, 1), (1, None)], "doc_id long, grade int")
    assert ordinal.fit(df, one, 3).thresholds[0] > -2.0
    assert df.limit(0).select(ordinal.graded(df, model)).count() == 0


def test_query(spark):
    rows = contract.op7_quality(spark, "/root/testdata/sf0.001").collect()
    assert len({r["doc_id"] for r in rows}) == 200 and all(0 <= r["p_tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)


MASK = (1 << 64) - 1


def spread(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_features(text):
    """{feature number: how many words have it} and the number of words, a word at a time."""
    code = lambda b: spread((b + 1) * 0x9E3779B97F4A7C15 & MASK)
    number = lambda h: h >> 64 - ordinal.BITS
    poly = lambda word: sum(code(b) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) & MASK
    low = lambda raw: bytes(b + 32 if 65 <= b < 91 else b for b in raw)
    raw, out = text.encode(), {}

    def add(h):
        out[number(h)] = out.get(number(h), 0) + 1

    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw):
        add(spread((poly(low(word)) + 1) & MASK))
        if len(word) > ordinal.HEAD:
            add(spread((poly(low(word)[: ordinal.HEAD]) + 2) & MASK))
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    for k, word in enumerate(words):
        signs = [b for b in word if b < 128 and not chr(b).isalnum()]
        if sum(map(code, signs)) & MASK:
            add(spread((sum(map(code, signs)) + 5) & MASK))
        if k and words[k - 1] == word:
            add(spread(3))
        if sum(65 <= b < 91 for b in word) >= 2:
            add(spread(4))
    return out, len(words)


def plain_fit(rows, grades):
    """The documented fit in plain loops: rows of ({feature: value}, grade)."""
    sig = lambda x: 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))
    n, mean = len(rows), sum(g for _, g in rows) / len(rows)
    features = sorted({f for x, _ in rows for f in x})
    scale = {f: sum(g - mean for x, g in rows if f in x) / (sum(f in x for x, _ in rows) + ordinal.SHRINK) for f in features}
    w, seen = dict.fromkeys(features, 0.0), dict.fromkeys(features, 1e-8)
    cuts = [-2 + k / max(1, grades - 2) for k in range(grades - 1)]
    seen_t = [1e-8] * (grades - 1)
    for _ in range(ordinal.PASSES):
        step, step_t = {f: ordinal.PENALTY * w[f] / n for f in features}, [0.0] * (grades - 1)
        for x, g in rows:
            score = sum(w[f] * v * scale[f] for f, v in x.items())
            a = sig(cuts[g - 1] - score) if g else 0.0
            b = sig(cuts[g] - score) if g < grades - 1 else 1.0
            p = max(b - a, 1e-9)
            da, db = (a * (1 - a) / p if g else 0.0), (b * (1 - b) / p if g < grades - 1 else 0.0)
            for f, v in x.items():
                step[f] += (db - da) / n * v * scale[f]
            if g:
                step_t[g - 1] += da / n
            if g < grades - 1:
                step_t[g] -= db / n
        for f in features:
            seen[f] += step[f] ** 2
            w[f] -= ordinal.STEP * step[f] / math.sqrt(seen[f])
        for k in range(grades - 1):
            seen_t[k] += step_t[k] ** 2
            cuts[k] -= 0.3 * ordinal.STEP * step_t[k] / math.sqrt(seen_t[k])
        cuts = [max(cuts[: k + 1]) for k in range(grades - 1)]
    return {f: w[f] * scale[f] for f in features}, cuts


def test_fit_and_score_against_plain_loops(spark):
    r = random.Random(6)
    good, bad, ugly = "prose about rivers, hills and towns".split(), "buy BUY now now now!!! $$$".split(), "vile nasty xxx ééé".split()
    rows = []
    for k in range(36):
        grade = k % 3
        rows.append((k, " ".join(r.choice((ugly, bad, good)[grade] if r.random() < 0.7 else good + bad) for _ in range(r.randrange(1, 12))), grade))
    rows += [(100, "", 2), (101, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int").repartition(3)
    model = ordinal.fit(df.drop("grade"), df.select("doc_id", "grade"), 3)
    told = [plain_features(t or "") for _, t, _ in rows]
    values = [{f: np.float32(ordinal.GAIN * c / max(1, n)).item() for f, c in x.items()} for x, n in told]
    weights, cuts = plain_fit([(x, g) for x, (*_, g) in zip(values, rows)], 3)
    assert model.thresholds == pytest.approx(cuts, abs=1e-6)
    got = {int(k): float(model.weights[k]) for k in np.flatnonzero(model.weights)}
    assert got == pytest.approx({f: v for f, v in weights.items() if v}, abs=1e-6)
    scored = {x["doc_id"]: x["g"] for x in df.select("doc_id", ordinal.graded(df, model).alias("g")).collect()}
    for (i, *_), (x, n) in zip(rows, told):
        score = ordinal.GAIN * sum(weights[f] * c for f, c in x.items()) / max(1, n)
        above = [1 - 1 / (1 + math.exp(-(c - score))) for c in cuts]
        assert (scored[i]["expected"], scored[i]["tail"]) == pytest.approx((sum(above), above[-1]), abs=1e-6)
    # the order of rows doesn't matter, nor which of an id's texts comes first
    twice = df.unionByName(spark.createDataFrame([(0, "another text of the first", 0)], df.schema))
    one, other = (ordinal.fit(x.drop("grade"), x.select("doc_id", "grade"), 3) for x in (twice.repartition(1).sortWithinPartitions("text"), twice.repartition(1).sortWithinPartitions(F.desc("text"))))
    assert (one.weights == other.weights).all() and (one.thresholds == other.thresholds).all()
