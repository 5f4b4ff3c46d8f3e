"""Suffix-array deduplication over UTF-8 bytes, by a distributed difference-cover algorithm.

Suffixes are compared by the 100 bytes that matter, so the order is cut off
there. The cover {0, 1, 4, 14, 16} modulo 21 is a perfect difference cover: any
two positions have one shift below 21 that puts both on it, and 80 bytes of the
window are left from there.

1. Sort sampled triples: at every cover position the triple of three 8-byte
   words is named, and the names are sorted within ranges of the name order. A
   triple that occurs once is discarded: no repeated window is aligned there.
2. Recurse on names: the names at a surviving position, 21 and 42 bytes on form
   a triple of names (66 bytes), which is named, sorted and discarded in the
   same way. This needs no texts: it reads what the first level sent back. A
   third level would reach beyond the 80 bytes, so this is the last.
3. Merge: the remaining suffixes, those that reach a surviving sample within
   20 bytes, are named by their 100-byte prefix and sorted by name and place.
4. Compare adjacent: all but the first suffix of equal prefix start later than
   an equal string; they go back to their text and their union is removed.

A name is a 64-bit fingerprint and sorts as a rank would. Ranks in dictionary
order would have to go back to every copy of a passage before the recursion;
a fingerprint is known at once in every block, so a passage that a third of all
documents hold is sent once for each block (see _blocks). The first two levels
send half a name: a wrong match there only keeps a sample that the merge drops.

"Earlier" is a smaller doc_id, or the same document and an earlier start; all
strings are judged on the input, and none crosses a document's end.

Defined cases: null text = no bytes; a null doc_id comes before all others;
rows with the same doc_id and the same text are one document (each row gets
its result); rows with the same doc_id and different texts are ordered by
their texts' md5; texts under 100 bytes lose nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import _blocks as B
from siltstone.llm._store import discard, read_table, settle
from siltstone.llm._text import chunks, combine, prefix_hash, span_hash

LENGTH, PERIOD, COVER = 100, 21, (0, 1, 4, 14, 16)
TRIPLE = 24


def ordinal(position_: np.ndarray) -> np.ndarray:
    """The number of the sample at a cover position of a text."""
    rank = np.zeros(PERIOD, np.int64)
    rank[list(COVER)] = np.arange(len(COVER))
    return position_ // PERIOD * len(COVER) + rank[position_ % PERIOD]


def position(number: np.ndarray) -> np.ndarray:
    return number // len(COVER) * PERIOD + np.array(COVER)[number % len(COVER)]


def _top(name: np.ndarray, count: int) -> np.ndarray:
    """The range of each name, in name order."""
    return ((name >> np.uint64(40)) * np.uint64(count) >> np.uint64(24)).astype(np.int32)


def _key(name: np.ndarray) -> np.ndarray:
    """A name whose sent half holds what the range does not tell: the top bits move to the end."""
    return name << np.uint64(24) | name >> np.uint64(40)


def _triples(count: int):
    """Level one: the triples of words at the cover positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = B.Block(count, merge=False)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for chunk in chunks(batch.column("text")):
                starts = B.cover_starts(chunk.offsets, PERIOD, COVER, TRIPLE, LENGTH)
                doc = chunk.doc_of(starts)
                own = block.new(ids[chunk.lo : chunk.hi])
                starts, doc = starts[own[doc]], doc[own[doc]]
                name = span_hash(prefix_hash(chunk.data), starts, starts + TRIPLE)
                block.add(_key(name), _top(name, count), doc, ordinal(starts - chunk.offsets[doc]).astype(np.uint32), ids[chunk.lo : chunk.hi])
                if block.size >= B.BLOCK_ENTRIES:
                    yield from block.rows()
        yield from block.rows()

    return run


def _sorted_names(level: int):
    """The samples whose name occurs twice; after level one with their names, which the recursion reads."""

    def run(table: pa.Table) -> pa.Table:
        name, block, doc, number = B.samples(table, False)
        twice = B.repeats(name)
        known, known_block, known_doc, known_number = B.samples(table, True)
        found = np.concatenate((number[twice], known_number))
        found = found.astype("<u8") << np.uint64(32) | np.concatenate((name[twice], known)).astype("<u8") if level == 1 else found.astype("<u4")
        return B.to_blocks(np.concatenate((block[twice], known_block)), np.concatenate((doc[twice], known_doc)), found, table)

    return run


def _triples_of_names(count: int):
    """Level two: triples of the names that survived, formed from one text's list of (sample number, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = B.Block(count, merge=False, carry=False)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            lists = [np.unique(np.frombuffer(x, dtype="<u8")) for x in batch.column("found").to_pylist()]
            if not lists:
                continue
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            value = np.concatenate(lists)
            place, name = doc << 32 | (value >> np.uint64(32)).astype(np.int64), value & np.uint64(0xFFFFFFFF)
            parts = [name]
            alive = np.ones(len(name), dtype=bool)
            for to in (place + len(COVER), place + 2 * len(COVER)):  # 21 and 42 bytes on
                at = np.minimum(np.searchsorted(place, to), len(place) - 1)
                alive &= place[at] == to
                parts.append(name[at])
            parts = [p[alive] for p in parts]
            new = combine(np.stack(parts, axis=1).reshape(-1), 3)[::3] if alive.any() else np.zeros(0, np.uint64)
            block.add(_key(new), _top(new, count), doc[alive], (place[alive] & 0xFFFFFFFF).astype(np.uint32), ids)
            if block.size >= B.BLOCK_ENTRIES:
                yield from block.rows()
        yield from block.rows()

    return run


def _suffixes(count: int):
    """The merge's entries: every suffix that reaches a surviving sample, named by its 100-byte prefix, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = B.Block(count, merge=True, names="<u8", carry=False)
        for batch in batches:
            rid, k, found = (batch.column(c).to_pylist() for c in ("rid", "k", "found"))
            for chunk in chunks(batch.column("text")):
                samples = np.concatenate([position(np.frombuffer(x, dtype="<u4").astype(np.int64)) + chunk.offsets[i] for i, x in enumerate(found[chunk.lo : chunk.hi])])
                starts = B.windows_around(chunk.offsets, samples, PERIOD, LENGTH)
                name = span_hash(prefix_hash(chunk.data), starts, starts + LENGTH)
                second = span_hash(prefix_hash(chunk.data, 1), starts, starts + LENGTH)
                doc = chunk.doc_of(starts)
                block.add(name, (second % np.uint64(count)).astype(np.int32), doc, (starts - chunk.offsets[doc]).astype(np.uint32), rid[chunk.lo : chunk.hi], k[chunk.lo : chunk.hi])
                if block.size >= B.BLOCK_ENTRIES:
                    yield from block.rows()
        yield from block.rows()

    return run


def kept_bytes(raw: bytes, starts: np.ndarray, length: int) -> tuple[int, int, str]:
    mask = B.covered(len(raw), starts, length)
    return B.mask_digest(mask, np.frombuffer(raw, dtype=np.uint8)[~mask].tobytes())


def removed_bytes(docs: DataFrame) -> DataFrame:
    """For each row doc_id, n, n_removed, n_spans and kept_sha256."""
    spark, rows = docs.sparkSession, B.keyed(docs)
    base = settle(rows.select("doc_id", "rid", "fp", "id", F.octet_length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), "bytes")
    reps = B.earliest(base)
    total = base.agg(F.sum("n")).first()[0] or 0

    count = B.ranges(total * len(COVER) // PERIOD, spark)
    sent = rows.select("id", "text").mapInArrow(_triples(count), B.ROW)
    level = settle(sent.groupBy("range").applyInArrow(_sorted_names(1), B.FOUND), "triples")
    count = B.ranges(total * len(COVER) // PERIOD // 4, spark)
    sent = B.by_id(level, "<u8").dropDuplicates(["id"]).mapInArrow(_triples_of_names(count), B.ROW)
    samples = settle(sent.groupBy("range").applyInArrow(_sorted_names(2), B.FOUND), "names")
    discard(level)

    suspects = settle(B.texts_of(rows, reps, B.by_id(samples, "<u4")), "suspects")
    discard(samples)

    count = B.ranges(total // 4, spark)
    later = settle(suspects.mapInArrow(_suffixes(count), B.ROW).groupBy("range").applyInArrow(B.later(count), B.LATER), "later")
    texts = suspects.select("rid", "k", "fp", "text").join(B.by_text(later), ["rid", "k"])
    digests = settle(texts.mapInArrow(B.digests(LENGTH, kept_bytes), B.DIGEST).dropDuplicates(["fp"]), "digests")
    discard(suspects, later)
    return B.outcome(base, reps, digests, LENGTH)


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(read_table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_bytes")
