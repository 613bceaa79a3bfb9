import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from lattica.llm import contract, media

SF = "/root/testdata/sf0.001"


def test_netpbm():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(b"P5 # note\n4 3\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P2\n4 3\n# c\n255\n" + " ".join(map(str, range(12))).encode()) == grey).all()
    deep = grey.astype(np.uint16) * 1000
    assert (media.decode(b"P5\n4 3\n65535\n" + deep.astype(">u2").tobytes()) == deep).all()
    colour = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (media.decode(b"P6\n4 2\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P1\n3 2\n1 0 1\n0 1 0") == [[0, 1, 0], [1, 0, 1]]).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == [[0, 1, 0], [1, 0, 1]]).all()
    for broken in (b"", b"P5", b"P5\n4 3\n255\nabc", b"P7\n", b"P5\n4 3\n0\n" + bytes(12), b"P5 # never ends"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_bmp():
    colour = np.random.default_rng(1).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + bytes(1) for r in colour[::-1])
    head = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, len(rows), 0, 0, 0, 0)
    assert (media.decode(head + rows) == colour).all()


def masked_bmp(pixels, masks, header=40):
    body = np.ascontiguousarray(pixels[::-1]).astype("<u4").tobytes()
    tall, wide = pixels.shape
    offset = 14 + max(header, 52)
    head = b"BM" + struct.pack("<IHHI", offset + len(body), 0, 0, offset) + struct.pack("<IiiHHIIiiII", header, wide, tall, 1, 32, 3, len(body), 0, 0, 0, 0)
    return head + struct.pack("<III", *masks) + bytes(offset - 66) + body


@pytest.mark.parametrize("header", [40, 108])
def test_bmp_masks(header):
    pixels = np.array([[10 | 20 << 8 | 30 << 16, 0xFFFFFFFF]], np.uint32)
    assert media.decode(masked_bmp(pixels, (0xFF, 0xFF00, 0xFF0000), header)).tolist() == [[[10, 20, 30], [255, 255, 255]]]
    assert media.decode(masked_bmp(pixels, (0xFF0000, 0xFF00, 0xFF), header)).tolist() == [[[30, 20, 10], [255, 255, 255]]]
    assert media.decode(masked_bmp(np.array([[31 << 11 | 5 << 5 | 4]], np.uint32), (31 << 11, 63 << 5, 31), header)).tolist() == [[[255, 20, 32]]]
    with pytest.raises(ValueError, match="gap"):
        media.decode(masked_bmp(pixels, (0x0F0F, 0, 0), header))


def test_images_of_all_kinds_in_a_store(spark, tmp_path):
    r = np.random.default_rng(3)
    colour = r.integers(0, 256, (9000, 5, 3)).astype(np.uint8)  # three tiles
    bmp = masked_bmp(colour[:7, :, 0].astype(np.uint32) << 16 | colour[:7, :, 1].astype(np.uint32) << 8 | colour[:7, :, 2], (0xFF0000, 0xFF00, 0xFF))
    deep = r.integers(0, 65536, (40, 30)).astype(np.uint16)
    rows = [(1, b"P6\n5 9000\n255\n" + colour.tobytes()), (2, bmp), (3, b"P5\n30 40\n65535\n" + deep.astype(">u2").tobytes()), (3, b"BM" + bytes(60))]
    media.store(spark.createDataFrame(rows, "k long, image binary"), f"file://{tmp_path}/i", "k", "image")
    got = sorted(spark.read.parquet(f"file://{tmp_path}/i").collect(), key=lambda x: (x["id"], x["error"] or ""))
    for row, want in zip(got, (colour, colour[:7], deep)):
        tiles = [np.load(io.BytesIO(bytes(t))) for t in row["tiles"]]
        assert (np.concatenate(tiles) == want).all() and tiles[0].dtype == want.dtype and row["hash"] == media.difference_hash(want)
    assert len(got[0]["tiles"]) == 3 and got[3]["error"]


def brute_hash(image):
    """The difference hash by exact fractions of the areas."""
    grey = image.mean(axis=2) if image.ndim == 3 else image.astype(float)
    tall, wide = grey.shape
    share = lambda n, k, i, m: max(0.0, min(i + 1, (k + 1) * m / n) - max(i, k * m / n))
    down = np.array([[share(8, k, i, tall) for i in range(tall)] for k in range(8)])
    over = np.array([[share(9, k, i, wide) for i in range(wide)] for k in range(9)])
    small = np.round(down @ grey @ over.T / (down.sum(axis=1)[:, None] * over.sum(axis=1)[None, :]), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


@pytest.mark.parametrize("band", [1 << 20, 64, 200])
def test_feature_against_exact_areas(monkeypatch, band):
    monkeypatch.setattr(media, "BAND", band)
    r = np.random.default_rng(band)
    for shape in ((1, 64), (3, 64), (100, 64), (17, 5), (8, 9), (33, 10, 3)):
        image = r.integers(0, 256, shape).astype(np.uint8)
        assert media.difference_hash(image) == brute_hash(image), shape
        cut = len(image) // 3
        assert media._hashed([x for x in (image[:cut], image[cut:]) if len(x)]) == brute_hash(image)


def test_memory_of_a_very_long_text():
    import tracemalloc

    text = np.random.default_rng(4).integers(32, 127, 40 << 20).astype(np.uint8).tobytes()
    tracemalloc.start()
    error, told, tiles = media._tiled(media.payload_image(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert error is None and len(told) == 16 and sum(map(len, tiles)) >= len(text)
    assert peak < 3.5 * len(text)  # the payload, its tiles and one band


def test_area_resize_is_the_mean_of_areas():
    image = np.random.default_rng(2).integers(0, 256, (16, 27)).astype(np.uint8)
    want = image.reshape(8, 2, 9, 3).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), want)
    fine = np.kron(image[:5, :7], np.ones((8, 9)))  # each new pixel covers parts of old ones
    assert np.allclose(media.area_resize(image[:5, :7], 8, 9), fine.reshape(8, 5, 9, 7).mean(axis=(1, 3)))


def test_npy_is_what_numpy_reads():
    for a in (np.arange(6, dtype=np.uint8).reshape(2, 3), np.zeros((1, 64), np.uint16), np.zeros((0, 3))):
        assert (np.load(io.BytesIO(media.npy(a))) == a).all()
        own = io.BytesIO()
        np.save(own, a)
        assert media.npy(a) == own.getvalue()
        assert (media.from_npy(own.getvalue()) == a).all()


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = contract.op10_media(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    by_text = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] >= r["payload_bytes"] and len(r["feature"]) == 16
        assert by_text.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]


def test_edges(spark, tmp_path):
    long = "é" * 300_000
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "x" * 64, 3), (2, long, 4)], "doc_id long, text string, hash int")
    media.store_texts(df, f"file://{tmp_path}/t")
    assert sorted(r["text"] for r in media.read_texts(spark, f"file://{tmp_path}/t").collect()) == sorted(["", "", "x" * 64, long])
    got = sorted((r["n_bytes"], r["payload_bytes"]) for r in media.features(spark, f"file://{tmp_path}/t").collect())
    assert got == [(0, 64), (0, 64), (64, 64), (600_000, 600_000)]
    images = spark.createDataFrame([(1, b"P5\n2 1\n255\nab"), (2, None), (3, b"nonsense")], "k long, image binary")
    media.store(images, f"file://{tmp_path}/i", "k", "image")
    rows = {r["id"]: r for r in spark.read.parquet(f"file://{tmp_path}/i").collect()}
    assert media.from_npy(bytes(rows[1]["tiles"][0])).tolist() == [[97, 98]] and rows[2]["error"] and rows[3]["tiles"] == []
    media.store_texts(df.limit(0), f"file://{tmp_path}/e")
    assert media.features(spark, f"file://{tmp_path}/e").count() == 0
