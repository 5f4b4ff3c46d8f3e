"""Token-id output: best-fit-decreasing packing into fixed id matrices.

Each task tokenises its documents, cuts overlong ones without loss, packs the
pieces best-fit, largest first, and finds the fullest bin with room by a
segment tree over capacities. A row is one line of the id matrix: the padded
ids and the position ids as little-endian bytes, the cumulative segment
lengths, and for each segment its document, piece and start. Tasks pack runs of
about `GROUP_TOKENS` tokens, so memory does not depend on the partition's size.

Ids take two bytes where every id of the vocabulary fits, else four; positions
two where the capacity allows. A width that is asked for and too small is an error.

Defined cases: null text = empty text (one end token); repeated rows are
packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._store import read_table
from siltstone.llm._tokens import cuts, default_path, document_ids, encoder, largest_id

CAPACITY, GROUP_TOKENS, PAD_ID = 2048, 4_000_000, 0


class CapacityTree:
    """A segment tree over room sizes: does a bin with so much room exist, and which is the least that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the fullest bin with at least `need` room, removed from the tree."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room, number = tree.take(sizes[i]) or (capacity, len(bins))
        if number == len(bins):
            bins.append([])
        bins[number].append(i)
        tree.put(room - sizes[i], number)
    return bins


PACKED = (
    "sequence_id long, n_tokens int, n_segments int, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


def _write(path: str, capacity: int, width: str, place_width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, count = encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        tokens = 0

        def lines():
            nonlocal count
            rows = []
            ids = np.full((1, capacity), PAD_ID, dtype=width)
            position = np.zeros((1, capacity), dtype=place_width)
            for items in best_fit_decreasing([len(held[i][3]) for i in range(len(held))], capacity):
                ids[:], position[:] = PAD_ID, 0
                ends = [0]
                for i in items:
                    a, b = ends[-1], ends[-1] + len(held[i][3])
                    ids[0, a:b], position[0, a:b] = held[i][3], np.arange(b - a)
                    ends.append(b)
                rows.append(((part << 32) | count, ends[-1], len(items), [held[i][0] for i in items], [held[i][1] for i in items], [held[i][2] for i in items], ends, ids.tobytes(), position.tobytes()))
                count += 1
                if len(rows) == 1000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)
            held.clear()

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = document_ids(enc, text.as_py())
                held += [(key, p, s, ids[s : s + n].astype(width)) for p, (s, n) in enumerate(cuts(len(ids), capacity))]
                tokens += len(ids)
                if tokens >= GROUP_TOKENS:
                    yield from lines()
                    tokens = 0
        yield from lines()

    def table(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sequence_id", "n_tokens", "n_segments", "doc_ids", "pieces", "starts", "cu_seqlens", "input_ids", "position_ids"])

    return run


def width_of(most: int, asked: int | None = None) -> str:
    """A little-endian unsigned type for numbers up to most; of `asked` bytes if that is given."""
    least = 2 if most < 1 << 16 else 4
    if asked is not None and (asked not in (2, 4) or asked < least):
        raise ValueError(f"{most} does not fit into {asked} bytes")
    return f"<u{asked or least}"


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_bytes: int | None = None) -> DataFrame:
    path = path or default_path()
    ids, places = width_of(largest_id(path), id_bytes), width_of(capacity - 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_write(path, capacity, ids, places), PACKED)


def write_packed(docs: DataFrame, folder: str, **options) -> None:
    """The packed lines as Parquet files in any store that Spark writes to."""
    packed_sequences(docs, **options).write.mode("errorifexists").parquet(folder)


def matrix(rows, column: str = "input_ids", id_bytes: int = 2) -> np.ndarray:
    """Collected lines as one id (or position) matrix."""
    return np.stack([np.frombuffer(bytes(r[column]), dtype=f"<u{id_bytes}") for r in rows])


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(read_table(spark, sf_dir, "documents"))
