import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import contract, tokenstore

SF = "/root/testdata/sf0.001"


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(contract.tokenizer_file())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_pieces_have_the_ids_of_the_whole_text():
    r = random.Random(4)
    some = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "×", "12", "'s", "'", "!", " ", " ", "\x1c", "\r\n", "漢", "😀", "\xa0", "\u2003", "—", "“", "²", "1"]
    encoder = tokenstore.Encoder(contract.tokenizer_file(), "<u2")
    for extra in ([], ["<|endoftext|>"]):
        texts = ["".join(r.choice(some + extra) for _ in range(r.randrange(30))) for _ in range(6000)] + ["", None]
        for k in range(0, len(texts), 1000):
            got = encoder.encode(pa.array(texts[k : k + 1000]))
            for t, x, y in zip(texts[k : k + 1000], got, whole(texts[k : k + 1000])):
                assert x.tolist() == y[:-1], repr(t)


def test_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    got = {r["doc_id"]: r for r in contract.op4_token_store(spark, SF).collect()}
    for d, ids in zip(docs, whole(d["text"] for d in docs)):
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_round_trip_and_edges(spark, tmp_path):
    long = " ".join(str(k * k) for k in range(9000))
    rows = [(3, "b c"), (1, None), (None, ""), (3, "b c"), (2, long), (4, long + " x"), (5, "same " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "ids").selectExpr("doc_id", "ids", "1 as name")
    path = f"file://{tmp_path}/s"
    tokenstore.write(df, path, contract.tokenizer_file(), text_col="ids")
    tokenstore.verify(spark, path)
    got = sorted(((-1 if r["doc"] is None else r["doc"]), r["ids"]) for r in tokenstore.reconstruct(spark, path).collect())
    assert got == sorted((-1 if i is None else i, x) for (i, _), x in zip(rows, whole(t for _, t in rows)))
    stored = spark.read.parquet(f"{path}/raw/kind=chunk").collect()
    assert len({bytes(r["name"]) for r in stored}) == len(stored)
    held = sum(len(r["body"]) for r in stored) / 2
    assert held < 0.6 * sum(len(x) for _, x in got)
    assert len(tokenstore.root(spark, path)) == 64
    assert tokenstore.starts(tokenstore.digests(spark, path)).count() == 7


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    tokenstore.write(spark.createDataFrame([], "doc_id long, text string"), path, contract.tokenizer_file())
    assert tokenstore.starts(tokenstore.digests(spark, path)).count() == 0


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    tokenstore.write(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), path, contract.tokenizer_file())
    chunk = f"{path}/raw/kind=chunk"
    spark.createDataFrame([(bytes(32), b"\1\0")], "name binary, body binary").write.mode("append").parquet(chunk)
    with pytest.raises(Exception, match="doesn't hold"):
        tokenstore.reconstruct(spark, path).collect() or tokenstore.digests(spark, path).collect()


def test_crc_of_joined_parts():
    r = random.Random(0)
    shift = tokenstore.CrcShift()
    for _ in range(300):
        a, b = r.randbytes(r.randrange(50)), r.randbytes(r.choice([0, 1, 4, 400, 5000]))
        assert shift.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_pieces_that_polynomials_modulo_2_to_the_64_confuse():
    encoder = tokenstore.Encoder(contract.tokenizer_file(), "<u2")
    for size in (1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") & 1] for k in range(size))
        texts = [word, word.translate(str.maketrans("ab", "ba")), f"x {word}", "b" + word]
        for x, y in zip(encoder.encode(pa.array(texts)), whole(texts)):
            assert x.tolist() == y[:-1]


def test_pieces_of_all_lengths_are_told_apart():
    encoder = tokenstore.Encoder(contract.tokenizer_file(), "<u2")
    texts = [c * n for c in "ab" for n in range(1, 40)] + ["a" * n + "\x00" * m for n in range(1, 18) for m in range(3)]
    for _ in range(2):
        for t, x, y in zip(texts, encoder.encode(pa.array(texts)), whole(texts)):
            assert x.tolist() == y[:-1], repr(t)


def test_one_key_for_two_pieces_goes_through_the_library(monkeypatch):
    encoder = tokenstore.Encoder(contract.tokenizer_file(), "<u2")
    monkeypatch.setattr(tokenstore, "mix", lambda x: x & np.uint64(1))
    texts = ["one two three", "four five six", "one two three four"]
    for _ in range(2):
        for x, y in zip(encoder.encode(pa.array(texts)), whole(texts)):
            assert x.tolist() == y[:-1]


def test_an_encoder_stays_small():
    encoder, k, most = tokenstore.Encoder(contract.tokenizer_file(), "<u2"), 0, 0
    for _ in range(16):
        encoder.encode(pa.array([" ".join(f"{x:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for x in range(k, k + 40_000))]))
        k += 40_000
        own = (encoder.names, encoder.lengths, encoder.starts, encoder.keys, encoder.places, encoder.flat)
        most = max(most, sum(x.nbytes for x in own))
    assert most < 40 << 20
