"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, kept as NPY tiles.

An image becomes tiles of at most TILE rows, each a complete NPY file, and a difference hash of the whole image shrunk
to 9 by 8. Tiles are lossless; the readers below open them without any state of the writer's.
"""

from __future__ import annotations

import ast
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm import staging
from lattica.llm.bytetext import slices, string_view

#: Rows of a tile.
TILE = 4096
#: Columns of the image that holds a payload.
PAYLOAD_WIDTH = 64
#: Samples of an integral image.
BAND = 1 << 20


def decode_netpbm(data: bytes) -> np.ndarray:
    """A PGM or PPM (P2, P3, P5, P6; up to 16 bits) or PBM (P1, P4) image as an array of rows, columns and, for colours, 3 channels."""
    kind, at, numbers = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                at = data.find(b"\n", at)
                if at < 0:
                    raise ValueError("the header ends in a comment")
            else:
                at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("the header isn't complete")
        numbers.append(int(data[at:end]))
        at = end
    width, height = numbers[:2]
    most = numbers[2] if len(numbers) > 2 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < most < 65536:
        raise ValueError("the largest sample must be 1 to 65535")
    shape = (height, width, 3) if channels == 3 else (height, width)
    count = width * height * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = [int(bytes([c])) for c in body if c in b"01"] if kind == b"P1" else [int(x) for x in body.split()]
        if len(values) < count:
            raise ValueError("samples are missing")
        out = np.array(values[:count], np.uint16 if most > 255 else np.uint8)
        return (1 - out if kind == b"P1" else out).reshape(shape)
    at += 1
    if kind == b"P4":
        line = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, line * height, at).reshape(height, line)
        return 1 - np.unpackbits(raw, axis=1)[:, :width]
    wide = np.dtype(">u2" if most > 255 else np.uint8)
    if len(data) - at < count * wide.itemsize:
        raise ValueError("samples are missing")
    return np.frombuffer(data, wide, count, at).astype(wide.newbyteorder("="), copy=False).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8 (with palette), 24 or 32 bits as an array of rows, columns and 3 channels; of 32 bits also with channel masks of any place and up to 8 bits or more, which are scaled to 8."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    offset, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if (packing, bits) not in ((0, 8), (0, 24), (0, 32), (3, 32)) or width <= 0 or height == 0:
        raise ValueError("a BMP of a kind that isn't supported")
    line = (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, line * abs(height), offset).reshape(abs(height), line)[:, : width * bits // 8]
    raw = raw[::-1] if height > 0 else raw
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if used > 256:
            raise ValueError("a palette of more than 256 colours")
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)
        return np.ascontiguousarray(palette[raw][:, :, 2::-1])
    if packing == 3:
        # the masks of red, green and blue stand behind the first 40 bytes of the header, whatever its length
        pixels = np.ascontiguousarray(raw).view("<u4")
        return np.stack([_channel(pixels, mask) for mask in struct.unpack_from("<III", data, 54)], axis=2)
    return np.ascontiguousarray(raw.reshape(abs(height), width, bits // 8)[:, :, 2::-1])


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits under a mask, scaled to 0 to 255."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    if most & (most + 1):
        raise ValueError("a channel mask with a gap")
    return (((pixels.astype(np.uint64) & np.uint64(mask)) >> np.uint64(low)) * np.uint64(255) // np.uint64(most)).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas that the new pixels cover: any size to any size, one pass over the samples."""
    return _resized([image], height, width)


def _resized(parts: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """area_resize() of the image that the parts make, one below the other. Integral images are made of BAND samples at a time and added up at the new pixels' edges, so memory doesn't grow with the image."""
    tall, wide = sum(map(len, parts)), parts[0].shape[1]
    rows, cols = np.linspace(0, tall, height + 1), np.linspace(0, wide, width + 1)
    at, total, first = np.zeros((height + 1, width + 1)), np.zeros(width + 1), 0
    step = max(1, BAND // max(1, wide))
    for part in parts:
        for k in range(0, len(part), step):
            band = part[k : k + step]
            grey = band.mean(axis=2) if band.ndim == 3 else band
            table = np.zeros((len(band) + 1, wide + 1))
            np.cumsum(grey, axis=0, out=table[1:, 1:])
            np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])
            across = _lines(table.T, cols).T
            own = np.flatnonzero((rows > first) & (rows <= first + len(band)))
            at[own] = total + _lines(across, rows[own] - first)
            total, first = total + across[-1], first + len(band)
    area = np.outer(np.diff(rows), np.diff(cols))
    return np.diff(np.diff(at, axis=0), axis=1) / area


def _lines(table: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Lines of an integral image at edges that may lie between two lines."""
    low = np.minimum(edges.astype(np.int64), len(table) - 2)
    part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
    return table[low] * (1 - part) + table[low + 1] * part


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 by 8 areas is darker than the one to its right. An image without pixels: zeros."""
    return _hashed([image])


def _hashed(parts: list[np.ndarray]) -> str:
    """difference_hash() of the image that the parts make."""
    if not sum(p.size for p in parts):
        return "0" * 16
    small = np.round(_resized(parts, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    """An array as the bytes of an NPY file, version 1.0."""
    head = f"{{'descr': '{np.lib.format.dtype_to_descr(array.dtype)}', 'fortran_order': False, 'shape': {array.shape!r}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode("latin1") + np.ascontiguousarray(array).tobytes()


def from_npy(data: bytes | memoryview) -> np.ndarray:
    """The array of an NPY file's bytes."""
    if bytes(data[:8]) != b"\x93NUMPY\x01\x00":
        raise ValueError("not an NPY file of version 1.0")
    size = struct.unpack_from("<H", data, 8)[0]
    head = ast.literal_eval(bytes(data[10 : 10 + size]).decode("latin1"))
    return np.frombuffer(data, np.dtype(head["descr"]), offset=10 + size).reshape(head["shape"])


def tiles(image: np.ndarray) -> list[bytes]:
    return [npy(image[k : k + TILE]) for k in range(0, len(image), TILE)]


def payload_image(text: bytes) -> bytes:
    """The PGM image of 64 columns whose samples are the bytes, filled up with zeros to whole rows, one at least."""
    rows = max(1, -(-len(text) // PAYLOAD_WIDTH))
    return b"P5\n%d %d\n255\n" % (PAYLOAD_WIDTH, rows) + text + bytes(rows * PAYLOAD_WIDTH - len(text))


def store(images: DataFrame, path: str, id_col: str, image_col: str) -> None:
    """Decode the images (binary) and write (id, error, hash, tiles array<binary>) at path.

    A null or broken image has no tiles and says why in error; it doesn't end the run. Rows that share an id have a row
    each; a null id stays null. Other columns of images are not read.
    """

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch):
                rows = [_tiled(x) for x in piece.column(1).to_pylist()]
                yield _tile_batch(piece.column(0), rows)

    source = images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image"))
    schema = f"id {dict(source.dtypes)['id']}, error string, hash string, tiles array<binary>"
    source.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def _pieces(batch, most: int = 8):
    for k in range(0, batch.num_rows, most):
        yield batch.slice(k, most)


def _tiled(data: bytes | None):
    if data is None:
        return "no image", None, []
    try:
        image = decode(data)
    except (ValueError, struct.error, IndexError) as e:
        return str(e), None, []
    return None, difference_hash(image), tiles(image)


def _tile_batch(ids, rows):
    return pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], ["id", "error", "hash", "tiles"])


def store_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """store() of the images that hold the texts' bytes, with the texts' lengths: (id, n_bytes, error, hash, tiles). Null is the empty text."""

    def run(batches):
        for batch in slices(batches):
            raw, at = string_view(batch.column(1))
            rows = [_tiled(payload_image(raw[a:b].tobytes())) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            told = _tile_batch(batch.column(0), rows)
            yield pa.RecordBatch.from_arrays([told.column(0), pa.array(np.diff(at), pa.int64()), *told.columns[1:]], ["id", "n_bytes", "error", "hash", "tiles"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, n_bytes long, error string, hash string, tiles array<binary>"
    source.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_texts(spark, path: str) -> DataFrame:
    """(id, text) of a store of texts."""

    def run(batches):
        for batch in batches:
            out = [b"".join(from_npy(t).tobytes() for t in x)[:n].decode() for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    stored = spark.read.parquet(path).select("id", "n_bytes", "tiles")
    return stored.mapInArrow(run, f"id {dict(stored.dtypes)['id']}, text string")


def features(spark, path: str) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored tiles.

    The hash is computed again from the samples that were read and must be the stored one.
    """

    def run(batches):
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            told = {n: [] for n in names}
            for stored, own in zip(batch.column(2).to_pylist(), batch.column(3)):
                # tiles are views of the batch's memory: nothing of the image's size is copied
                payload, media, size, read, parts, tail = hashlib.sha256(), hashlib.sha256(), 0, 0, [], b""
                for x in own.values:
                    file = memoryview(x.as_buffer())
                    media.update(file)
                    size += len(file)
                    parts.append(from_npy(file))
                    payload.update(memoryview(parts[-1]).cast("B"))
                    read += parts[-1].nbytes
                    tail = (tail + parts[-1].reshape(-1)[-64:].tobytes())[-64:]
                if _hashed(parts) != stored:
                    raise ValueError("the samples read don't have the stored hash")
                row = (read, payload.hexdigest(), zlib.crc32(tail), size, media.hexdigest(), stored)
                for n, v in zip(names, row):
                    told[n].append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(told[n], k) for n, k in zip(names, kinds))], ["id", "n_bytes", *names])

    stored = spark.read.parquet(path).select("id", "n_bytes", "hash", "tiles")
    return stored.mapInArrow(run, f"id {dict(stored.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: texts stored in the shared folder and read back."""
    spark = docs.sparkSession
    path = staging.shared_folder(spark)
    store_texts(docs, path)
    return features(spark, path).withColumnRenamed("id", "doc_id")
