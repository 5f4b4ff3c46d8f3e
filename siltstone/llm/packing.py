"""Best-fit packing by hierarchical residual packing.

Documents become token pieces of at most `capacity` tokens (a longer document
is cut without loss; its first piece takes the remainder). Each partition packs
its pieces best-fit, largest first, and lets go of nearly full bins. The
underfull bins go on as single items: fewer partitions, each with a bounded
number of items, pack them best-fit again, and so on until one partition is
left or a round after the first saves under 1/200 of its items as bins; what is
then still underfull stays so. No task ever holds more than about
`MAX_ITEMS` items.

A bin carries its pieces with it (at most `capacity` of them), so the result
needs no join.

Defined cases: null text = empty text (one piece that holds the end token);
repeated rows are packed as often as they occur; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._store import read_table, settle
from siltstone.llm._tokens import cuts, default_path, document_ids, encoder

CAPACITY, NEARLY_FULL, MAX_ITEMS, FAN_IN = 2048, 0.99, 50_000, 4
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN = f"used int, bin long, members array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = document_ids(enc, text.as_py())
                rows += [(key, p, s, n, zlib.crc32(ids[s : s + n])) for p, (s, n) in enumerate(cuts(len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pieces(path or default_path(), capacity), PIECE)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: largest first, into the fullest bin with room.

    The bins with r tokens left wait under r; one integer has bit r set where
    some do, so the smallest sufficient room is its lowest set bit.
    """
    bins: list[list[int]] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            number = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
            bins[number].append(i)
        else:
            room, number = capacity, len(bins)
            bins.append([i])
        left = room - size
        if not waiting[left]:
            rooms |= 1 << left
        waiting[left].append(number)
    return bins


def _pack(turn: int, capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        count = 0
        held: list[tuple[int, list]] = []

        def emit():
            nonlocal count
            rows = []
            for items in best_fit([held[i][0] for i in range(len(held))], capacity):
                rows.append((sum(held[i][0] for i in items), (turn << 56) | (part << 28) | count, [m for i in items for m in held[i][1]]))
                count += 1
            held.clear()
            return pd.DataFrame(rows, columns=["used", "bin", "members"])

        for frame in frames:
            held += list(zip(frame["used"].tolist(), frame["members"], strict=True))
            if len(held) >= MAX_ITEMS:
                yield emit()
        if held:
            yield emit()

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """pieces with sequence_id and offset; the sum of lengths in a sequence is at most capacity."""
    spark = pieces.sparkSession
    columns = [x.split()[0] for x in PIECE.split(", ")]
    enough = int(nearly_full * capacity)
    single = pieces.select(F.col("length").cast("int").alias("used"), F.array(F.struct(*columns)).alias("members"))
    n = single.count()
    parts = max(1, -(-n // MAX_ITEMS))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(parts, min(wide, -(-n // 4096))) if n else 1
    items, done, rounds = single.repartition(partitions), [], 0
    while True:
        bins = settle(items.mapInPandas(_pack(rounds, capacity), BIN), f"bins-{rounds}")
        under = bins.filter(F.col("used") < enough)
        left = under.count()
        merged = n - bins.count()
        rounds += 1
        if partitions == 1 or not left or (rounds > 1 and merged * 200 < n) or rounds == 60:
            done.append(bins)
            break
        done.append(bins.filter(F.col("used") >= enough))
        partitions = max(1, -(-left // MAX_ITEMS), -(-partitions // FAN_IN))
        items, n = under.select("used", "members").repartition(partitions), left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    before = F.expr("transform(sequence(1, size(members)), i -> aggregate(slice(members, 1, i - 1), 0L, (a, m) -> a + m.length))")
    return out.select("bin", F.explode(F.arrays_zip(F.col("members").alias("m"), before.alias("o"))).alias("x")).select("x.m.*", F.col("bin").alias("sequence_id"), F.col("x.o").alias("offset"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = settle(token_pieces(read_table(spark, sf_dir, "documents")), "pieces")
    return pack(pieces)
