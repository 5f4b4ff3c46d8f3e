"""Entries of many texts, sent to sorted ranges and back in packed rows.

A block of documents sends each distinct name once to the range that the name
falls in, so a passage that a third of all documents hold reaches a range once
for each block, not once for each document; what repeats within the block is
known to repeat and travels by a hash of its text. Ranges are chosen so that one
holds a bounded number of entries.

Entries of samples name their text by its number in the block; one row of each
block carries the texts' ids, and what the ranges find goes back by block.
Entries of a merge carry the order of their texts instead and go back by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._store import heavy_join, settle
from siltstone.llm._text import mix

BLOCK_ENTRIES, RANGE_ENTRIES = 1_500_000, 2_000_000
FIRST = -(1 << 63)  # stands for a null doc_id: before all others
ROW = "range int, known boolean, block long, name binary, pos binary, doc binary, k binary, size binary, ids binary"
COLUMNS = [x.split()[0] for x in ROW.split(", ")]
#: In a range of bounded size half a fingerprint tells names apart; a wrong match only adds a suspect.
SHORT = np.uint64(32)


def ranges(entries: int, spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // RANGE_ENTRIES))


def _press(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def shrink(values: np.ndarray) -> bytes:
    """Non-negative whole numbers, in as few bytes each as they take, compressed."""
    most = values.max() if len(values) else 0
    width = "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8"
    return width[-1].encode() + _press(values.astype(width))


def grow(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), dtype=f"<u{packed[:1].decode()}").astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal entries starts."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def repeats(name: np.ndarray) -> np.ndarray:
    """Whether each name occurs twice or more."""
    order = np.argsort(name, kind="stable")
    start = changes(name[order])
    size = np.diff(np.append(start, len(name)))
    twice = np.empty(len(name), dtype=bool)
    twice[order] = np.repeat(size > 1, size)
    return twice


def text_rank(rid: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of each entry's text in the order of (rid, k); equal texts have equal ranks."""
    order = np.lexsort((k, rid))
    new, rank = np.zeros(len(rid), dtype=np.int64), np.empty(len(rid), dtype=np.int64)
    new[changes(rid[order], k[order])] = 1
    rank[order] = np.cumsum(new)
    return rank


class Block:
    """Collects entries (name, range, text, position) and packs them.

    merge: texts are given as (rid, k); of equal names the earliest is sent and
    the others are known to be later; their names stay here. Otherwise texts are
    given by ids, one entry of each name is sent, and every entry whose name
    occurs twice is known to repeat. `names` is the width of a sent name; `carry`
    sends the names of known entries too; `places` sends positions.
    """

    def __init__(self, count: int, merge: bool, names: str = "<u4", carry: bool = True, places: bool = True):
        self.count, self.merge, self.names, self.carry, self.places = count, merge, names, carry, places
        self.number = TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0
        self.ids: list[int] = []
        self.k: list[int] = []
        self.texts: set[int] = set()

    def new(self, ids: list[int]) -> np.ndarray:
        """Which of these texts are the first of their id in the block; a copy stands for nothing of its own."""
        out = np.zeros(len(ids), dtype=bool)
        for i, x in enumerate(ids):
            out[i] = x not in self.texts
            self.texts.add(x)
        return out

    def add(self, name, to, doc, pos, ids: list[int], k: list[int] | None = None) -> None:
        self.parts.append((name, to, doc + len(self.ids), pos))
        self.ids += ids
        self.k += k or []
        self.size += len(name)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self.clear()
            return
        name, to, doc, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids, k = np.array(self.ids, dtype=np.int64), np.array(self.k, dtype=np.int64)
        number = self.number
        self.number += 1
        self.clear()
        order = np.argsort(name, kind="stable")
        start = changes(name[order])
        size = np.diff(np.append(start, len(name)))
        sent = np.zeros(len(name), dtype=bool)
        if self.merge:
            place = (text_rank(ids, k)[doc] << 32) | pos
            sent[order] = place[order] == np.repeat(np.minimum.reduceat(place[order], start), size)
            known = ~sent
        else:
            sent[order[start]] = True
            known = np.empty(len(name), dtype=bool)
            known[order] = np.repeat(size > 1, size)
        home = (mix(ids.view(np.uint64) ^ mix(k.view(np.uint64)) if self.merge else ids.view(np.uint64)) % np.uint64(self.count)).astype(np.int64)
        out = []
        for flag, chosen in ((False, sent), (True, known)):
            i = np.flatnonzero(chosen)
            place = home[doc[i]] if flag else to[i]
            order = np.argsort(place.astype(np.uint16 if self.count < 1 << 16 else np.int32), kind="stable")
            i, place = i[order], place[order]
            docs = changes(place, doc[i])
            step = pos[i].astype(np.int64)
            step[1:] -= step[:-1].copy()
            step[docs] = pos[i][docs]
            counts, chosen_names = np.diff(np.append(docs, len(i))), name[i]
            cut = changes(place[docs]).tolist()
            for a, b in zip(cut, [*cut, len(docs)][1:], strict=True):
                lo, hi = docs[a], docs[b] if b < len(docs) else len(i)
                of = doc[i[docs[a:b]]]
                shown = (chosen_names[lo:hi] >> (SHORT if self.names == "<u4" else np.uint64(0))).astype(self.names)
                text = (_press(np.diff(ids[of], prepend=0)), shrink(k[of])) if self.merge else (shrink(np.diff(of, prepend=0)), b"")
                out.append((int(place[lo]), flag, number, shown.tobytes() if self.carry or not flag else b"", shrink(step[lo:hi]) if self.places else b"", *text, shrink(counts[a:b]), None))
        if not self.merge:
            out[0] = (*out[0][:-1], ids.tobytes())
        kinds = (pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 6)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=COLUMNS)


def _listed(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _places(row: dict, size: np.ndarray) -> np.ndarray:
    if not row["pos"]:
        return np.zeros(int(size.sum()), np.int64)
    step = grow(row["pos"])
    total, start = np.cumsum(step), np.cumsum(size) - size
    return total - np.repeat(total[start] - step[start], size)


def samples(table: pa.Table, known: bool):
    """name, block, number of the text in it and pos of a range's sample entries."""
    parts = []
    for row in table.filter(table.column("known") if known else pc.invert(table.column("known"))).to_pylist():
        size = grow(row["size"])
        parts.append((np.frombuffer(row["name"], dtype="<u4"), np.full(int(size.sum()), row["block"], np.int64), np.repeat(np.cumsum(grow(row["doc"])), size), _places(row, size)))
    return tuple(_listed([p[i] for p in parts], kind) for i, kind in enumerate(("<u4", np.int64, np.int64, np.int64)))


#: What comes back to a block: its texts' numbers, how much each found, and what; or (doc null) the ids of its texts.
FOUND = "block long, doc binary, size binary, found binary"


def to_blocks(block, doc, values, table: pa.Table) -> pa.Table:
    """What a range found, a row for each block, and the ids that came with the blocks' rows."""
    order = np.lexsort((values, doc, block))
    block, doc, values = block[order], doc[order], values[order]
    text = changes(block, doc)
    size, cut, out = np.diff(np.append(text, len(doc))), changes(block[text]).tolist(), []
    for a, b in zip(cut, [*cut, len(text)][1:], strict=True):
        lo, hi = text[a], text[b] if b < len(text) else len(doc)
        out.append((int(block[lo]), shrink(np.diff(doc[text[a:b]], prepend=0)), shrink(size[a:b]), _press(values[lo:hi])))
    named = table.filter(pc.is_valid(table.column("ids")))
    out += [(x, None, None, y) for x, y in zip(named.column("block").to_pylist(), named.column("ids").to_pylist(), strict=True)]
    kinds = (pa.int64(), *[pa.binary()] * 3)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["block", "doc", "size", "found"])


def _resolve(values: str):
    def run(table: pa.Table) -> pa.Table:
        ids, parts = np.zeros(0, np.int64), []
        for row in table.to_pylist():
            if row["doc"] is None:
                ids = np.frombuffer(row["found"], dtype=np.int64)
            else:
                parts.append((np.repeat(np.cumsum(grow(row["doc"])), grow(row["size"])), np.frombuffer(zstandard.ZstdDecompressor().decompress(row["found"]), dtype=values)))
        doc, value = _listed([p[0] for p in parts], np.int64), _listed([p[1] for p in parts], values)
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        text = changes(doc)
        return pa.table({"id": pa.array(ids[doc[text]]), "found": pa.array([x.tobytes() for x in np.split(value, text[1:])] if len(text) else [], pa.binary())})

    return run


def by_id(packed: DataFrame, values: str) -> DataFrame:
    """One row (id, found) for each text of a block of which something was found, its values in order."""
    return packed.groupBy("block").applyInArrow(_resolve(values), "id long, found binary")


LATER = "part int, rid binary, k binary, size binary, found binary"


def later(parts: int) -> Callable:
    """A merge: entries sorted by name and place; all but the first of equal names, and what was known, by the part of their text."""

    def run(table: pa.Table) -> pa.Table:
        both = []
        for known in (False, True):
            found = []
            for row in table.filter(table.column("known") if known else pc.invert(table.column("known"))).to_pylist():
                size = grow(row["size"])
                rid = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["doc"]), dtype=np.int64))
                found.append((np.frombuffer(row["name"], dtype="<u8"), np.repeat(rid, size), np.repeat(grow(row["k"]), size), _places(row, size)))
            both.append(tuple(_listed([p[i] for p in found], kind) for i, kind in enumerate(("<u8", np.int64, np.int64, np.int64))))
        name, rid, k, pos = both[0]
        again = repeats(name)
        name, rid, k, pos = name[again], rid[again], k[again], pos[again]
        order = np.lexsort(((text_rank(rid, k) << 32) | pos, name))
        order = np.delete(order, changes(name[order]))
        _, known_rid, known_k, known_pos = both[1]
        return _to_texts(np.concatenate((rid[order], known_rid)), np.concatenate((k[order], known_k)), np.concatenate((pos[order], known_pos)).astype("<u4"), parts)

    return run


def _ordered(rid, k, values, part):
    """Sorted by part, text and value, with the place where each text starts."""
    order = np.lexsort((values, k, rid, part))
    rid, k, values, part = rid[order], k[order], values[order], part[order]
    return rid, k, values, part, changes(part, rid, k)


def _to_texts(rid, k, values, parts: int) -> pa.Table:
    """What a range found, packed by the part to which its texts belong: a row for each part, not for each text."""
    part = (mix(rid.view(np.uint64) ^ mix(k.view(np.uint64))) % np.uint64(parts)).astype(np.int32)
    rid, k, values, part, text = _ordered(rid, k, values, part)
    size, cut, out = np.diff(np.append(text, len(rid))), changes(part[text]).tolist(), []
    for a, b in zip(cut, [*cut, len(text)][1:], strict=True):
        lo, hi = text[a], text[b] if b < len(text) else len(rid)
        out.append((int(part[lo]), rid[text[a:b]].tobytes(), shrink(k[text[a:b]]), shrink(size[a:b]), _press(values[lo:hi])))
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["part", "rid", "k", "size", "found"])


def _by_text(table: pa.Table) -> pa.Table:
    rids, ks, found = [], [], []
    for row in table.to_pylist():
        size = grow(row["size"])
        rids.append(np.repeat(np.frombuffer(row["rid"], dtype=np.int64), size))
        ks.append(np.repeat(grow(row["k"]), size))
        found.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["found"]), dtype="<u4"))
    rid, k, value = (np.concatenate(x) for x in (rids, ks, found))
    rid, k, value, _, text = _ordered(rid, k, value, np.zeros(len(rid), np.int32))
    return pa.table({"rid": pa.array(rid[text]), "k": pa.array(k[text]), "found": pa.array([x.tobytes() for x in np.split(value, text[1:])], pa.binary())})


def by_text(packed: DataFrame) -> DataFrame:
    """One row (rid, k, found) for each text with later windows, their starts in order."""
    return packed.groupBy("part").applyInArrow(_by_text, "rid long, k long, found binary")


def cover_starts(bounds: np.ndarray, period: int, cover: tuple[int, ...], sample: int, length: int) -> np.ndarray:
    """Cover positions with a full sample, in documents that have a window at all."""
    sizes = np.diff(bounds)
    usable = np.where(sizes >= length, sizes - sample + 1, 0)
    first = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(usable)[:-1])), usable)
    starts = np.arange(len(first)) + first
    place = starts - np.repeat(bounds[:-1], usable)
    on_cover = np.zeros(period, dtype=bool)
    on_cover[list(cover)] = True
    return starts[on_cover[place % period]]


def windows_around(bounds: np.ndarray, samples_: np.ndarray, period: int, length: int) -> np.ndarray:
    """Starts of the windows that reach one of the samples within a period."""
    doc = np.searchsorted(bounds, samples_, side="right") - 1
    low = np.maximum(bounds[doc], samples_ - period + 1)
    high = np.minimum(samples_, bounds[doc + 1] - length)
    ok = high >= low
    delta = np.zeros(int(bounds[-1]) + 2, dtype=np.int32)
    np.add.at(delta, low[ok], 1)
    np.add.at(delta, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(delta) > 0)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:-1]) > 0


def digests(length: int, keep: Callable):
    """For each text with later windows: what is removed and the hash of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fp, text, found in zip(*(batch.column(c) for c in ("fp", "text", "found")), strict=True):
                starts = np.frombuffer(found.as_py(), dtype="<u4").astype(np.int64)
                rows.append((fp.as_py(), *keep((text.as_py() or "").encode(), starts, length)))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["fp", "n_removed", "n_spans", "kept_sha256"])

    return run


DIGEST = "fp binary, n_removed long, n_spans long, kept_sha256 string"


def mask_digest(mask: np.ndarray, kept: bytes) -> tuple[int, int, str]:
    return int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, rid (never null), fp (which stands for the text), id (a shorter stand-in for finding suspects) and text of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(FIRST)).alias("rid"), F.unhex(F.md5(text.cast("binary"))).alias("fp"), F.xxhash64(text).alias("id"), text.alias("text"))


def earliest(base: DataFrame) -> DataFrame:
    """(fp, rid, id, copies, k): for each text its earliest row.

    k orders the texts of one rid by their md5 and tells them apart; it is 0
    where a rid has one text. Nothing is sorted or collected for a rid, as a
    third of all rows may have none.
    """
    reps = settle(base.groupBy("fp").agg(F.min("rid").alias("rid"), F.first("id").alias("id"), F.count(F.lit(1)).alias("copies")), "texts")
    several = settle(reps.groupBy("rid").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").withColumn("several", F.lit(True)), "several")
    order = F.conv(F.substring(F.hex("fp"), 1, 15), 16, 10).cast("long")
    return heavy_join(reps, several, "rid", "texts").select("fp", "rid", "id", "copies", F.when(F.col("several"), order).otherwise(F.lit(0).cast("long")).alias("k"))


def texts_of(rows: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """rid, k, fp, text and found: the earliest row of each text of which something was found, repeated rows once."""
    # copies of a text in several blocks found the same: every sample of it
    wanted = reps.join(found.dropDuplicates(["id"]), "id")
    each = rows.select("rid", "fp", "text").dropDuplicates(["rid", "fp"])  # a repeated row is no later copy of itself
    return each.join(wanted, ["rid", "fp"]).select("rid", "k", "fp", "text", "found")


def outcome(base: DataFrame, reps: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The result of every row of base: its text's digest if it is the text's earliest row, else all of it is removed.

    base has n (units) and sha256 (of what is kept if nothing is removed).
    """
    firsts = settle(reps.select("fp", F.col("rid").alias("first"), "copies").join(found, "fp", "left"), "firsts")
    copy = F.col("rid") != F.col("first")
    whole = copy & (F.col("n") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return heavy_join(base, firsts, "fp", "copies").select(
        "doc_id", "n",
        F.when(whole, F.col("n")).when(copy, F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(copy, F.lit(0)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).when(copy, F.col("sha256")).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
