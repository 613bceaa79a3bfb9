"""Texts of Arrow batches as byte arrays: words, their hashes and hashes of word windows, all vectorised.

Every word class used here is a set of bytes under 0x80 plus, or minus, everything from 0x80, so words of
UTF-8 bytes and words of code points are the same.

Words and windows of words are known by polynomials modulo the prime 2**61 - 1 at points that a seed gives. Two different
words of up to 56 bytes, or two different windows of n words, meet at no more than 9, or n, of the 2**61 points; longer
words go through BLAKE2b with a key from the seed first. Where a result depends on equality, the seed is drawn anew for
each run, so no text can be made to collide, and two families of points are used together.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import secrets

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomials modulo 2**64, which serve where equality decides nothing: features and cuts. Fixed.
WORD_BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: The modulus of all other hashes, bytes of a word that are taken as one number, and most such numbers of a word.
PRIME, LANE, LANES = (1 << 61) - 1, 7, 8


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads each bit of 64 over all of them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_codes() -> np.ndarray:
    """A fixed 64-bit number for each byte."""
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def lowered() -> np.ndarray:
    """Bytes with A-Z in lower case."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def alnum_bytes() -> np.ndarray:
    """Bytes of the class [0-9A-Za-z] and all from 0x80: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z is lower-cased."""
    out = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        out[a:b] = True
    return out


def nonspace_bytes() -> np.ndarray:
    """Bytes of the class `[^\\x20\\x09-\\x0D]`."""
    out = np.ones(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = False
    return out


def string_view(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, offsets from 0; null is the empty text. Nothing is copied unless there are nulls."""
    if texts.null_count:
        texts = texts.fill_null("")
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give memory that was freed back to the system: a worker lives on between tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than glibc's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches, most: int = 1 << 20, text: int = 1):
    """Record batches cut into pieces of about `most` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = string_view(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
        release()


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> Powers:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(size, base, U64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self


def new_seed() -> int:
    """A seed that no text can know; draw it once on the driver, so that all tasks of a run share it."""
    return secrets.randbits(64)


class Kit:
    """What a task keeps between pieces: points that the seed gives, powers and byte tables."""

    def __init__(self, seed: int = 0):
        self.word, self.gram = Powers(WORD_BASE), Powers(GRAM_BASE)
        self.codes = byte_codes()
        self.key = hashlib.blake2b(seed.to_bytes(8, "little"), digest_size=32).digest()

    def point(self, use: str, family: int) -> int:
        """A residue other than 0 and 1."""
        return 2 + int.from_bytes(hashlib.blake2b(f"{use} {family}".encode(), key=self.key).digest(), "little") % (PRIME - 2)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    p = U64(PRIME)
    x = (x & p) + (x >> U64(61))
    return np.where(x >= p, x - p, x)


def times(x: np.ndarray, y: int) -> np.ndarray:
    """x * y modulo the prime, for x under 2**62 and a residue y: products of halves of 31 bits, none beyond 64 bits."""
    high, low, y_high, y_low = x >> U64(31), x & U64((1 << 31) - 1), U64(y >> 31), U64(y & (1 << 31) - 1)
    middle = high * y_low + low * y_high
    return reduced(((high * y_high) << U64(1)) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << U64(31)) + low * y_low)


def lanes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The first min(size, width) bytes from each start as a little-endian number; width is at most 8. raw has 16 bytes behind the last start."""
    body = raw[: len(raw) // 8 * 8].view("<u8")
    place, turn = start >> 3, ((start & 7) << 3).astype(U64)
    out = (body[place] >> turn) | ((body[place + 1] << U64(1)) << (U64(63) - turn))
    short = ((8 - np.minimum(size, width)) << 3).astype(U64)
    return (out << short) >> short


def padded(raw: np.ndarray) -> np.ndarray:
    """A copy of raw with at least 24 bytes of zeros behind it, a multiple of 8 in all."""
    out = np.zeros((len(raw) + 31) // 8 * 8, np.uint8)
    out[: len(raw)] = raw
    return out


def prefix_sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=out[1:])
    return out


class Words:
    """The words of a piece: byte bounds, and for each text the range of its words."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, inside: np.ndarray):
        self.raw, self.at = raw, at
        is_in = inside[raw]
        n = len(raw)
        if n:
            head, tail = is_in.copy(), is_in.copy()
            head[1:] &= ~is_in[:-1]
            tail[:-1] &= ~is_in[1:]
            begins = at[:-1][at[:-1] < at[1:]]  # of texts with bytes
            head[begins] = is_in[begins]
            ends = at[1:][at[:-1] < at[1:]] - 1
            tail[ends] = is_in[ends]
            self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, at)  # words before each text
        self.counts = np.diff(self.first)

    def hashes(self, kit: Kit, fold: bool = False, family: int = 0) -> np.ndarray:
        """A residue for each word's bytes, A-Z lower-cased first if `fold`."""
        if not len(self.start):
            return np.zeros(0, U64)
        raw = padded(lowered()[self.raw] if fold else self.raw)
        size, point = self.end - self.start, kit.point("word", family)
        out = size.astype(U64)
        own, at, left = np.arange(len(size)), self.start, size
        for k in range(LANES):
            value = times(out[own] + lanes(raw, at, left, LANE), point)
            out[own] = value
            more = np.flatnonzero(left > LANE)
            if not len(more):
                break
            own, at, left = own[more], at[more] + LANE, left[more] - LANE
        for w in np.flatnonzero(size > LANE * LANES).tolist():
            digest = hashlib.blake2b(raw[self.start[w] : self.end[w]].tobytes(), key=kit.key, salt=bytes([family]), digest_size=16).digest()
            out[w] = int.from_bytes(digest, "little") % PRIME
        return out

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text start there or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def windows(words: np.ndarray, n: int, kit: Kit, family: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every n consecutive words' residues, as if there were one text only: polynomials at the
    family's point, each from two polynomials of half the length, with their bits spread over 64."""
    count = max(0, len(words) - n + 1)
    if not count:
        return np.zeros(0, U64)
    point = kit.point("window", family)
    out, have = np.zeros(count, U64), 0
    power, size = words, 1  # hashes of `size` consecutive words
    while True:
        if n & size:
            # what is taken so far stands in front: it moves up by `size` places
            out = reduced(times(out, pow(point, size, PRIME)) + power[have : have + count])
            have += size
        if have == n:
            return mix(out + U64(1))
        power = reduced(times(power[:-size], pow(point, size, PRIME)) + power[size:])
        size *= 2


def gram_hashes(words: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Rolling hashes modulo 2**64 of every n consecutive numbers, as if there were one text only; for cuts, not for equality."""
    count = max(0, len(words) - n + 1)
    powers = powers.to(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = prefix_sums(words * powers.up[: len(words)])
        return mix((sums[n : n + count] - sums[:count]) * powers.down[:count] + U64(n))
