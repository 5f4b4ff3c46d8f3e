"""Benchmark decontamination by pigeonhole edit matching.

An item of L code points may be met with up to L // 20 edits. It is cut into
that many pieces plus one; whoever holds the item within the budget holds at
least one piece unchanged. An Aho-Corasick automaton finds every piece in one
pass over a text, and Myers' bit-parallel distance verifies the item against
the text around each hit. A to Z count as a to z.

Items are searched in blocks of bounded size, each block against all
documents, so that what one task holds does not grow with the benchmark; a
benchmark of up to `BLOCK_CHARS` code points takes one pass over the documents.

An item under `EDIT_SHARE` code points has no edits to spend and is found only
exactly and between word boundaries (no letter or digit next to it), as it
would otherwise match inside words by chance.

Defined cases: null and blank items are never searched; null texts match nothing;
repeated items and repeated documents each give their own rows; an item found
several times in a text gives one row with the smallest distance, the first
place of it; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._store import read_table

EDIT_SHARE = 20
BLOCK_CHARS = 4_000_000
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces that cover the item, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def symbol_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edits that turn the item into a piece of text, and where the first such piece ends."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(x | up))
        minus = up & x
        if score < best:
            best, end = score, at
    return best, end


def alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit stands right before or after text[start:end]."""
    return not (start and text[start - 1].isalnum()) and not text[end : end + 1].isalnum()


class Searcher:
    """The automaton of a block of items and what verification needs."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [(key, low, len(low) // EDIT_SHARE) for key, text in items if (low := text.translate(ASCII_LOWER)).strip()]
        self.masks = [symbol_masks(low) for _, low, _ in self.items]
        words: dict[str, list[tuple[int, int]]] = {}
        for i, (_, low, budget) in enumerate(self.items):
            for offset, piece in pieces(low, budget):
                words.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in words.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if words:
            self.automaton.make_automaton()
        self.any = bool(words)

    def search(self, text: str, first: bool = False) -> list[tuple[int, int, int]]:
        """(item number, distance, end) of each item in the text; with `first`, stop at one."""
        found: dict[int, tuple[int, int]] = {}
        if not self.any or not text:
            return []
        low = text.translate(ASCII_LOWER)
        tried = set()
        for last, (size, uses) in self.automaton.iter(low):
            for i, offset in uses:
                start = last - size + 1 - offset
                if (i, start) in tried or found.get(i, (1,))[0] == 0:
                    continue
                tried.add((i, start))
                _, item, budget = self.items[i]
                at = max(0, start - budget)
                if not budget:
                    distance, end = (0 if len(item) >= EDIT_SHARE or alone(low, start, start + len(item)) else 1), len(item)
                else:
                    distance, end = myers(self.masks[i], len(item), low[at : max(0, start + len(item) + budget)])
                if distance <= budget and (i not in found or (distance, at + end) < found[i]):
                    found[i] = (distance, at + end)
                    if first:
                        return [(i, *found[i])]
        return [(i, d, e) for i, (d, e) in sorted(found.items())]


def _search(searcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Searcher(searcher.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rows += [(key, block.items[i][0], d, e, len(block.items[i][1])) for i, d, e in block.search(text.as_py() or "")]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "distance", "match_end", "item_length"])

    return run


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about BLOCK_CHARS code points; each is collected by itself."""
    usable = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length(F.trim("text")) > 0)
    size = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // BLOCK_CHARS)
    for b in range(count):
        yield [(r.item_id, r.text) for r in usable.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)) == b).orderBy("item_id", "text").collect()]


LEAKS = "doc_id long, item_id long, distance int, match_end long, item_length int"


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item found in it within the item's budget."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(items):
        found = texts.mapInArrow(_search(spark.sparkContext.broadcast(block)), LEAKS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], LEAKS) if out is None else out


def _clean(searcher, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Searcher(searcher.value)
        for batch in batches:
            yield batch.filter(pa.array([not block.search(t.as_py() or "", first=True) for t in batch.column(text)], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    out = docs
    for block in blocks(items):
        out = out.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), text), docs.schema)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
