"""Substring deduplication over words, by difference-cover anchors.

Only windows at positions of the perfect difference cover {0, 1, 3, 9} modulo
13 are hashed as anchors (8 words each). Any two equal runs of 20 words share
an aligned anchor; around anchors that repeat, the match is extended to the
full 20 words and every later occurrence is removed.

1. Anchors: each block of documents sends its distinct anchors to their ranges;
   what repeats goes back to its texts.
2. Texts with repeated anchors, one for each group of equal texts (its earliest
   row, and of repeated rows one), are written to the shared folder.
3. Extension: every window of 20 words that reaches a repeated anchor is sent
   with its place, again once for each block. Sorted by name and place, all but
   the first of equal windows start later. They go back to their text, and
   their union is removed.

Names have 64 bits; a window's range comes from a second, independent hash.
"Earlier" is a smaller doc_id, or the same document and an earlier start; all
windows are judged on the input.

Defined cases: null text = no words; a null doc_id comes before all others;
rows with the same doc_id and the same text are one document (each row gets
its result); rows with the same doc_id and different texts are ordered by
their texts' md5; texts under 20 words lose nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import _blocks as B
from siltstone.llm._store import discard, read_table, settle
from siltstone.llm._text import Words, chunks, combine, word_hashes

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1


def _anchors(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = B.Block(count, merge=False, places=False)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for chunk in chunks(batch.column("text")):
                words = Words(chunk)
                starts = B.cover_starts(words.bounds, PERIOD, COVER, ANCHOR, WINDOW)
                doc = np.searchsorted(words.bounds, starts, side="right") - 1
                own = block.new(ids[chunk.lo : chunk.hi])
                starts, doc = starts[own[doc]], doc[own[doc]]
                name = combine(word_hashes(chunk.data, words), ANCHOR)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
                block.add(name, (name % np.uint64(count)).astype(np.int32), doc, np.zeros(len(name), np.uint32), ids[chunk.lo : chunk.hi])
                if block.size >= B.BLOCK_ENTRIES:
                    yield from block.rows()
        yield from block.rows()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    name, block, doc, _ = B.samples(table, False)
    twice = B.repeats(name)
    known, known_block, known_doc, _ = B.samples(table, True)
    return B.to_blocks(np.concatenate((block[twice], known_block)), np.concatenate((doc[twice], known_doc)), np.concatenate((name[twice], known)), table)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _extend(count: int):
    """Every window that reaches a repeated anchor, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = B.Block(count, merge=True, names="<u8", carry=False)
        for batch in batches:
            rid, k, found = (batch.column(c).to_pylist() for c in ("rid", "k", "found"))
            for chunk in chunks(batch.column("text")):
                words = Words(chunk)
                hashes = word_hashes(chunk.data, words)
                starts = B.cover_starts(words.bounds, PERIOD, COVER, ANCHOR, WINDOW)
                short = (combine(hashes, ANCHOR)[starts] >> B.SHORT).astype("<u4") if len(starts) else np.zeros(0, "<u4")
                cut, hit = np.searchsorted(starts, words.bounds), np.zeros(len(starts), dtype=bool)
                for i, values in enumerate(found[chunk.lo : chunk.hi]):
                    hit[cut[i] : cut[i + 1]] = _member(np.frombuffer(values, dtype="<u4"), short[cut[i] : cut[i + 1]])
                at = B.windows_around(words.bounds, starts[hit], PERIOD, WINDOW)
                name = combine(hashes, WINDOW)[at] if len(at) else np.zeros(0, dtype=np.uint64)
                second = combine(hashes, WINDOW, 0x1F83D9AB)[at] if len(at) else name
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                block.add(name, (second % np.uint64(count)).astype(np.int32), doc, (at - words.bounds[doc]).astype(np.uint32), rid[chunk.lo : chunk.hi], k[chunk.lo : chunk.hi])
                if block.size >= B.BLOCK_ENTRIES:
                    yield from block.rows()
        yield from block.rows()

    return run


def kept_words(raw: bytes, starts: np.ndarray, length: int) -> tuple[int, int, str]:
    words = raw.split()
    mask = B.covered(len(words), starts, length)
    return B.mask_digest(mask, b" ".join(w for w, gone in zip(words, mask.tolist(), strict=True) if not gone))


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest = [], []
        for text in batch.column("text"):
            words = text.as_py().encode().split()
            n.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), batch.column("fp"), batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "rid", "fp", "id", "n", "sha256"])


def removed_words(docs: DataFrame) -> DataFrame:
    """For each row doc_id, n, n_removed, n_spans and kept_sha256."""
    rows = B.keyed(docs)
    base = settle(rows.mapInArrow(_base, "doc_id long, rid long, fp binary, id long, n long, sha256 string"), "words")
    reps = B.earliest(base)
    total = base.agg(F.sum("n")).first()[0] or 0

    count = B.ranges(total * len(COVER) // PERIOD, docs.sparkSession)
    sent = rows.select("id", "text").mapInArrow(_anchors(count), B.ROW)
    repeated = settle(sent.groupBy("range").applyInArrow(_repeated, B.FOUND), "anchors")
    suspects = settle(B.texts_of(rows, reps, B.by_id(repeated, "<u4")), "suspects")
    discard(repeated)

    count = B.ranges(total // 4, docs.sparkSession)
    found = settle(suspects.mapInArrow(_extend(count), B.ROW).groupBy("range").applyInArrow(B.later(count), B.LATER), "later")
    texts = suspects.select("rid", "k", "fp", "text").join(B.by_text(found), ["rid", "k"])
    digests = settle(texts.mapInArrow(B.digests(WINDOW, kept_words), B.DIGEST).dropDuplicates(["fp"]), "digests")
    discard(suspects, found)
    return B.outcome(base, reps, digests, WINDOW)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(read_table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_words").drop("n_spans")
