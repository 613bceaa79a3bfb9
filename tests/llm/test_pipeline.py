import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lattica.llm import contract, mixing, ordinal
from tests.llm.test_mixing import filled
from tests.llm.test_ngramjoin import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = contract.table(spark, SF, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        out.append(rows)
        if name != "token_store":
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages_are_those_of_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1]))


def test_quality(spark, stages):
    labels = {r["doc_id"]: r for r in contract.table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept for i in good) > 0.95 * len(good)
    assert not [i for i, r in labels.items() if r["toxic"] == 1 and i in kept]
    assert {tuple(r) for r in stages[1]} <= {tuple(r) for r in stages[0]}


def test_near_duplicates(stages):
    want = {i for i, _, least in brute([(r["doc_id"], r["text"]) for r in stages[1]], 5, 80, 100) if i == least}
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(want)


def test_decontamination(spark, stages):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = set()
    for r in contract.table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        n = min(13, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    want = []
    for r in stages[2]:
        w = words(r["text"])
        hit = {p for n in {len(g) for g in grams} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(want)


def test_mixture(stages):
    size = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
    sizes, taken = Counter(), Counter()
    for r in stages[3]:
        sizes[r["source"]] += size(r["text"])
    for r in stages[4]:
        taken[r["source"]] += size(r["text"])
    largest = max(size(r["text"]) for r in stages[3])
    for s, want in filled(sizes, mixing.WEIGHTS, mixing.TOTAL, mixing.MOST).items():
        assert abs(taken[s] - want) <= largest
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 2
    assert {tuple(r) for r in stages[4]} <= {tuple(r) for r in stages[3]}


def test_token_store(stages):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(contract.tokenizer_file()), 0, []
    for r in sorted(stages[4], key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in stages[5]) == sorted(want)


def test_edges(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(None, text, "en", "s", 1, 9), (1, None, "en", None, 0, 9), (2, "", None, "s", 0, 9), (3, text, "en", "s", None, 9), (4, text, "en", "s", 1, 9), (4, text, "en", "s", 1, 9), (5, "a b " * 30000, "en", "t", 1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_1 int").withColumnRenamed("text_1", "grade")
    for df in (docs, docs.limit(0)):
        for table, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
            spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
            if name != "token_store":
                assert df.columns == docs.columns
                df = spark.createDataFrame(df.collect(), docs.schema)
        df.collect()
