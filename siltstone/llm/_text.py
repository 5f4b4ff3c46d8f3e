"""Vectorised text helpers used inside Spark tasks.

Texts arrive as Arrow string columns; these helpers work on the raw UTF-8
bytes of a bounded chunk of documents at a time, so that memory in a Python
worker depends on the chunk limit and the longest single text, never on the
number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: The separators of a word: space and the control range tab..carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes with A-Z mapped to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64)


BYTE_VALUES = (_table(20240511), _table(77003))
_powers: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i in 0..n."""
    if 0 not in _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for key, base in ((0, _BASE), (1, _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray, table: int = 0) -> np.ndarray:
    """Running polynomial hash of a byte array; feed it to span_hash."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    values = BYTE_VALUES[table][data]
    values *= powers(len(data))[0][: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of data[start:end]."""
    return mix((running[end] - running[start]) * powers(len(running))[1][start])


class Chunk:
    """A run of documents as one byte array. Nulls are empty texts."""

    __slots__ = ("data", "hi", "lo", "offsets")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.data, self.offsets, self.lo, self.hi = data, offsets, lo, hi

    def __len__(self) -> int:
        return self.hi - self.lo

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array within each document."""
        running = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(flags, out=running[1:])
        return running[self.offsets[1:]] - running[self.offsets[:-1]]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split an Arrow string column into chunks of at most `limit` bytes (one text at least)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi)
        lo = hi


class Words:
    """The words of a chunk: byte spans, and for each document its range of words."""

    __slots__ = ("bounds", "end", "start")

    def __init__(self, chunk: Chunk):
        space = SPACE[chunk.data]
        n = len(space)
        after = np.ones(n + 1, dtype=bool)
        after[1:] = space
        inner = chunk.offsets[(chunk.offsets < n)]
        after[inner] = True
        self.start = np.flatnonzero(after[:-1] & ~space)
        before = np.ones(n + 1, dtype=bool)
        before[:-1] = space
        before[inner] = True
        self.end = np.flatnonzero(~space & before[1:]) + 1
        self.bounds = np.searchsorted(self.start, chunk.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return span_hash(prefix_hash(data), words.start, words.end)


def combine(hashes: np.ndarray, size: int, seed: int = 0x51ED2701) -> np.ndarray:
    """Hashes of every run of `size` consecutive entries (across document ends; mask those)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factor = np.uint64((seed * 0x2545F4914F6CDD1D + 0x9E3779B97F4A7C15) % (1 << 64) | 1)
    out = np.full(n, seed, dtype=np.uint64)
    for i in range(size):
        out *= factor
        out += hashes[i : i + n]
    return mix(out)


def runs(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document with >= size entries, the starts of its full runs, and their document."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(len(docs)) + first, docs


def crc_remainder(ids: list, modulus: int = 5) -> np.ndarray:
    """crc32 of each id written as text, modulo `modulus`; -1 for a null id."""
    import zlib

    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids], dtype=np.int64)
