"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct n-word shingles (64-bit fingerprints). Two
documents link when intersection / union reaches the threshold. Equal sets are
one class and need no comparison. For the rest:

1. A count sketch of fixed size, filled from all documents, orders shingles
   rare first. Any fixed order gives the same links; this one keeps the lists
   below short.
2. Each class sends the prefix that a linked partner must share to the buckets
   of its shingles. A block of documents sends a class once.
3. In a bucket, classes that share a prefix shingle and pass the length and
   positional filters are candidates. First come only the pairs with each
   list's most central class, so a group of near copies costs its size, not its
   square, however many it has.
4. The suffix filter bounds the overlap of a pair by two small histograms of
   their whole sets, before any text moves. What passes is verified once, on
   whole sets.
5. Components are formed. All other pairs of short lists (up to `SHORT_LIST`)
   that are still in different components are then filtered and verified too.
   Longer lists are searched with more and more pivots of their own, until in
   the last round every member is one, so no link between different texts is lost.

Texts are compared under a 64-bit hash of their own (rid), never under doc_id:
rows of one doc_id, or of none, need not hold the same text.

Defined cases: a null or empty text has no set and links with nothing; a text
shorter than a shingle is one shingle; an empty table gives an empty result.
In the query, as in its SQL, a class of equal sets is named by its least
doc_id and classes of one name are one node; a set that only rows with a null
doc_id hold has no name, links with nothing and has a null component_id; other
columns are ignored. `drop_near_copies` compares every row whatever its doc_id,
and carries all columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._components import components
from siltstone.llm._store import discard, heavy_join, read_table, settle
from siltstone.llm._text import LOWER, Chunk, Words, chunks, combine, runs, word_hashes

SKETCH_BITS, SKETCH_SLICES, SHORT_LIST = 20, 64, 24
BLOCK_ENTRIES, BUCKET_ENTRIES = 1_000_000, 400_000
#: Pairs of one class that are verified in one place, and how long lists are searched: one member in 2 ** shift is a pivot.
PAIR_GROUP, PIVOT_SHIFTS, SALTS = 10_000, (12, 8, 4, 0), 32
#: Bits of the marks that keep texts without a candidate partner out of the shuffle.
MARK_BITS = 25


def shingle_sets(chunk: Chunk, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each document of a chunk."""
    low = Chunk(LOWER[chunk.data], chunk.offsets, chunk.lo, chunk.hi)
    words = Words(low)
    hashes = word_hashes(low.data, words)
    starts, _ = runs(words.bounds, size)
    shingles = combine(hashes, size)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
    counts = np.maximum(words.counts() - size + 1, 0)
    parts = np.split(shingles, np.cumsum(counts)[:-1])
    out = []
    for i, part in enumerate(parts):
        a, b = words.bounds[i], words.bounds[i + 1]
        if a < b < a + size:
            part = combine(hashes[a:b], int(b - a), 0xA5A5 + int(b - a))
        out.append(np.unique(part))
    return out


def need(total, num: int, den: int):
    """The least intersection of two linked sets whose sizes add up to total."""
    return -(-num * total // (den + num))


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


FIRST_PASS = "rid long, doc_id long, md5 binary, n long, fp binary, shape binary, slice int, counts binary"
NAMES = [x.split()[0] for x in FIRST_PASS.split(", ")]


def shape(values: np.ndarray) -> bytes:
    """A histogram of a sorted set with a cell for some four shingles; 255 stands for 255 or more."""
    cells = min(4096, max(16, 1 << (len(values) // 4).bit_length()))
    return np.minimum(np.bincount((values >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def overlap_bound(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """At most this many shingles are common to two sets of these shapes, of which the smaller has `most`."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    full = np.zeros(len(x), dtype=bool)
    if len(x) < len(y):
        full |= (y == 255).reshape(len(x), -1).any(axis=1)
        y = y.reshape(len(x), -1).sum(axis=1, dtype=np.int64)
    else:
        full |= y == 255
    high = np.iinfo(np.int64).max >> 20
    x = np.where(x == 255, high, x.astype(np.int64))
    return min(most, int(np.minimum(x, np.where(full, high, y)).sum()))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            n, fp, shapes = [], [], []
            for chunk in chunks(batch.column("text")):
                sets = shingle_sets(chunk, size)
                n += [len(s) for s in sets]
                fp += [hashlib.md5(s.tobytes()).digest() for s in sets]
                shapes += [shape(s) for s in sets]
                if len(every := np.concatenate(sets)):
                    sketch += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id"), batch.column("md5"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(shapes, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=NAMES)
        rows = np.split(sketch, SKETCH_SLICES)
        yield pa.record_batch([*[pa.nulls(SKETCH_SLICES, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())], pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=NAMES)

    return run


def _add_slices(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.uint32).astype(np.uint64) for x in table.column("counts"))
    return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})


def _sketch(first: DataFrame) -> np.ndarray:
    """Shingle counts by fingerprint prefix, added up in two steps of about equal size; 4 MB whatever the corpus."""
    rows = first.filter(F.col("slice").isNotNull()).select("slice", "counts")
    groups = max(1, math.isqrt(rows.count() // SKETCH_SLICES))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(groups)))
    some = rows.groupBy("slice", "part").applyInArrow(_add_slices, "slice int, counts binary")
    done = some.groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary").collect()
    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), dtype=np.uint32)
    for r in done:
        out[r.slice] = np.frombuffer(bytes(r.counts), dtype=np.uint32)
    return out.reshape(-1)


POSTED = "bucket int, token binary, doc binary, pos binary, rid binary, n binary, sig binary, score binary"


def _postings(sketch, size: int, num: int, den: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        best: dict[bytes, tuple[int, np.ndarray, int, int]] = {}
        held = 0

        def block():
            nonlocal held
            keys = list(best.items())
            rid = np.array([v[0] for _, v in keys], dtype=np.int64)
            n = np.array([v[2] for _, v in keys], dtype=np.int32)
            score = np.array([v[3] for _, v in keys], dtype=np.int64)
            sig = np.array([np.frombuffer(k[:8], dtype=np.int64)[0] for k, _ in keys], dtype=np.int64)
            token = np.concatenate([v[1] for _, v in keys])
            sizes = np.array([len(v[1]) for _, v in keys])
            doc = np.repeat(np.arange(len(keys)), sizes)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                docs, index = np.unique(doc[part], return_inverse=True)
                out.append((int(bucket[part[0]]), token[part].tobytes(), index.astype(np.uint32).tobytes(), pos[part].astype(np.uint32).tobytes(), rid[docs].tobytes(), n[docs].tobytes(), sig[docs].tobytes(), score[docs].tobytes()))
            best.clear()
            held = 0
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 7), strict=True)], names=[x.split()[0] for x in POSTED.split(", ")])

        for batch in batches:
            rids = batch.column("rid").to_pylist()
            for chunk in chunks(batch.column("text")):
                for i, values in enumerate(shingle_sets(chunk, size)):
                    if not len(values):
                        continue
                    key, rid = hashlib.md5(values.tobytes()).digest(), rids[chunk.lo + i]
                    if key in best:
                        if rid < best[key][0]:
                            best[key] = (rid, *best[key][1:])
                        continue
                    count = counts[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.lexsort((values, count))
                    prefix = values[order[: prefix_length(len(values), num, den)]]
                    best[key] = (rid, prefix, len(values), int(count.mean() * 16))
                    held += len(prefix)
                if held >= BLOCK_ENTRIES:
                    yield from block()
        if best:
            yield from block()

    return run


FOUND = "token long, a long, b long, first boolean, n long, pos long"


def passes(na, nb, pa_, pb, num: int, den: int):
    """Length and positional filters for two sets that share a shingle at these places."""
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need(na + nb, num, den))


def _candidates(num: int, den: int, short_list: int):
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for row in table.to_pylist():
            doc = np.frombuffer(row["doc"], dtype=np.uint32)
            at = lambda c, t: np.frombuffer(row[c], dtype=t)[doc]  # noqa: B023, E731
            parts.append((np.frombuffer(row["token"], dtype=np.uint64), at("rid", np.int64), at("n", np.int32).astype(np.int64), np.frombuffer(row["pos"], dtype=np.uint32).astype(np.int64), at("sig", np.int64), at("score", np.int64)))
        token, rid, n, pos, sig, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
        keep = count[inverse] > 1
        token, rid, n, pos, sig, score = (x[keep] for x in (token, rid, n, pos, sig, score))
        order = np.lexsort((rid, sig, n, token))
        token, rid, n, pos, sig, score = (x[order] for x in (token, rid, n, pos, sig, score))
        if len(token):
            keep = np.concatenate(([True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])))
            token, rid, n, pos, score = (x[keep] for x in (token, rid, n, pos, score))
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(token)))
        size_of = np.repeat(size, size)
        left, right, early = [], [], []
        # each list's most central class, the least rid on a tie
        order = np.lexsort((rid, -score, np.repeat(start, size)))
        pivot = np.repeat(order[start], size)

        def offer(i, j):
            ok = passes(n[i], n[j], pos[i], pos[j], num, den) & (rid[i] != rid[j])
            i, j = i[ok], j[ok]
            swap = (score[j] > score[i]) | ((score[j] == score[i]) & (rid[j] < rid[i]))
            left.append(np.where(swap, rid[j], rid[i]))
            right.append(np.where(swap, rid[i], rid[j]))
            early.append((pivot[i] == i) | (pivot[j] == j))

        every = np.arange(len(token))
        offer(pivot, every)
        short = size_of <= short_list
        for step in range(1, short_list):
            i = every[: len(token) - step] if len(token) > step else every[:0]
            ok = short[i] & (token[i] == token[i + step])
            if not ok.any():
                break
            offer(i[ok], i[ok] + step)
        long = np.flatnonzero(~short)
        a, b, first = (np.concatenate(x) for x in (left, right, early))
        order = np.lexsort((~first, b, a))
        a, b, first = a[order], b[order], first[order]
        keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        a, b, first = a[keep], b[keep], first[keep]
        zero = np.zeros(len(a), np.int64)
        return pa.table({
            "token": np.concatenate((zero, token[long].view(np.int64))), "a": np.concatenate((a, rid[long])), "b": pa.array(np.concatenate((b, rid[long])), mask=np.concatenate((np.zeros(len(a), bool), np.ones(len(long), bool)))),
            "first": np.concatenate((first, np.zeros(len(long), bool))), "n": np.concatenate((zero, n[long])), "pos": np.concatenate((zero, pos[long])),
        })

    return run


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return den * common >= num * (len(x) + len(y) - common)


def _suffix_filter(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
                ok.append(overlap_bound(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), min(na, nb)) >= need(na + nb, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [s for c in chunks(batch.column("text_a")) for s in shingle_sets(c, size)]
            right = [s for c in chunks(batch.column("text_b")) for s in shingle_sets(c, size)]
            ok = [linked(x, y, num, den) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _maybe_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose rid may be in ids: none that is there is lost, few others come along while `MARK_BITS` is large.

    The marks are at most 2 ** (MARK_BITS - 6) rows of two longs whatever the corpus, so broadcasting them is safe;
    when they are all set this lets every row through.
    """
    slot = lambda: F.pmod(F.xxhash64("rid"), F.lit(1 << MARK_BITS))
    word, bit = F.shiftright(slot(), 6).alias("_word"), slot().bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    marks = ids.select(word, bit).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mark"))
    return rows.select("*", word, bit).join(F.broadcast(marks), "_word").filter(F.getbit("_mark", "_bit") == 1).drop("_word", "_bit", "_mark")


def _links(pairs: DataFrame, shapes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The candidate pairs that link: bounded by their shapes, then each verified once on whole texts.

    A text is dealt once, as the b of its pairs; with each pair it moves to the
    pair's a, at most PAIR_GROUP pairs to one place.
    """
    of = lambda s: shapes.select(F.col("rid").alias(s), F.col("n").alias("n" + s), F.col("shape").alias("x" + s))
    kept = settle(pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").mapInArrow(_suffix_filter(num, den), "a long, b long"), "pairs")
    many = settle(kept.groupBy("a").agg(F.count(F.lit(1)).alias("copies")).withColumn("groups", F.expr(f"cast(copies div {PAIR_GROUP} as int) + 1")), "pivots")
    ids = many.select(F.col("a").alias("rid")).union(kept.select("b")).distinct()
    # dealt by rid once, for both sides, each text once; the joins drop what came along
    texts = _maybe_in(docs.select("rid", "text"), ids).dropDuplicates(["rid"])
    placed = heavy_join(kept, many, "a", "copies").withColumn("group", F.pmod(F.xxhash64("b"), F.col("groups")))
    pivots = many.select(F.col("a").alias("rid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups").cast("long") - 1)).alias("group")).join(texts.withColumnRenamed("text", "text_a"), "rid").withColumnRenamed("rid", "a")
    both = placed.select("a", "b", "group").join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").join(pivots, ["a", "group"])
    links = settle(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, num, den), "a long, b long"), "links")
    discard(kept, many)
    return links


def _of(ids: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """ids with the component of one of its keys; a key without one is its own."""
    return ids.join(labels.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))


def _mixed(long: DataFrame) -> DataFrame:
    """The long lists whose members are in different components."""
    return settle(long.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token"), "mixed")


def _more_pivots(long: DataFrame, mixed: DataFrame, shift: int, before: int | None, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of mixed lists in different components, one of them a pivot, that pass the filters; pivots of an earlier round are done."""
    slot = lambda c, s: F.pmod(F.xxhash64(F.lit(97), c), F.lit(1 << s)) == 0
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS))
    spread = lambda rows: rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    long = long.withColumn("salt", salt).join(spread(mixed), ["token", "salt"])
    side = lambda rows, s: rows.select("token", "salt", *[F.col(c).alias(c + s) for c in ("rid", "n", "pos", "component")])
    done = F.lit(False) if before is None else slot("ridx", before) | slot("ridy", before)
    least = F.ceil(num * (F.col("nx") + F.col("ny")) / F.lit(den + num))
    pairs = side(spread(long.drop("salt").filter(slot("rid", shift))), "x").join(side(long, "y"), ["token", "salt"]).filter(
        (F.col("ridx") != F.col("ridy")) & (F.col("componentx") != F.col("componenty")) & ~done
        & (den * F.least("nx", "ny") >= num * F.greatest("nx", "ny")) & (F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy")) >= least)
    )
    return pairs.select(F.least("ridx", "ridy").alias("a"), F.greatest("ridx", "ridy").alias("b")).distinct()


def near_copies(docs: DataFrame, size: int, num: int, den: int, named: bool = False, short_list: int = SHORT_LIST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, md5, n, fp) for each row of docs (doc_id, text), and (fp, id, component) for each class of equal sets.

    id is the class's least doc_id. With `named`, only classes that have one
    take part, and those of one id are one node.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"))
    first = settle(rows.withColumn("md5", F.unhex(F.md5(F.col("text").cast("binary")))).mapInArrow(_sets(size), FIRST_PASS), "sets")
    base = first.filter(F.col("slice").isNull()).select("doc_id", "rid", "md5", "n", "fp")
    sketch = spark.sparkContext.broadcast(_sketch(first))
    total = base.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-total * (den - num) // den // BUCKET_ENTRIES))

    of = F.col("doc_id").isNotNull() if named else F.lit(True)
    rows = rows.filter(of)
    posted = rows.select("rid", "text").mapInArrow(_postings(sketch, size, num, den, buckets), POSTED)
    found = settle(posted.groupBy("bucket").applyInArrow(_candidates(num, den, short_list), FOUND), "candidates")
    pairs = settle(found.filter("b is not null").groupBy("a", "b").agg(F.max("first").alias("first")), "offers")
    shapes = settle(first.filter("n > 0").groupBy("rid").agg(F.first("n").alias("n"), F.first("shape").alias("shape")), "shapes")
    classes = settle(base.filter("n > 0").filter(of).groupBy("fp").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")

    edges = _links(pairs.filter("first"), shapes, rows, size, num, den)
    if named:
        several = classes.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("id", "a")
        edges = edges.unionByName(classes.join(several, "id").select("a", F.col("rep").alias("b")))
    labels = settle(components(edges), "components")
    long = found.filter("b is null").select("token", F.col("a").alias("rid"), "n", "pos")
    rest = _of(_of(pairs.filter("not first").select("a", "b"), labels, "a", "x"), labels, "b", "y").filter("x <> y").select("a", "b")
    before = None
    for shift in (None, *PIVOT_SHIFTS):
        if shift is not None:
            listed = _of(long, labels, "rid", "component")
            mixed = _mixed(listed)
            if mixed.isEmpty():
                break
            before, rest = shift, _more_pivots(listed, mixed, shift, before, num, den)
        rest = settle(rest, "rest")
        if not rest.isEmpty():
            more = _links(rest, shapes, rows, size, num, den)
            if not more.isEmpty():
                edges = edges.unionByName(more)
                labels = settle(components(edges), "components")
        discard(rest)
    discard(found, pairs, shapes)
    labels = labels.select(F.col("node").alias("rep"), "component")
    return base, classes.join(labels, "rep", "left").select("fp", "id", "copies", F.coalesce("component", "rep").alias("component"))


def drop_near_copies(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component stays, the one with the least doc_id (null before all others); all columns are carried.

    Of several rows with one doc_id the one with the least md5 of its text
    stays, and one of rows that repeat both. A row without a shingle stays.
    """
    base, classes = near_copies(docs.select("doc_id", "text"), size, num, den)
    base = base.filter("n > 0")
    place = F.struct("doc_id", "md5", "rid")  # a null is least
    best = base.groupBy("fp").agg(F.min(place).alias("best"))
    stays = classes.join(best, "fp").groupBy("component").agg(F.min("best").alias("best")).select("best.doc_id", "best.rid")
    same = lambda a, b: a["rid"].eqNullSafe(b["rid"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    rows = settle(base.groupBy("doc_id", "rid").count(), "near-copies")
    stays = settle(stays, "stays")
    gone = rows.join(stays, same(rows, stays), "left_anti").select("doc_id", "rid")
    # the input's columns stay together in one, so that no name of theirs meets one of ours
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("of"))
    match = lambda a, b: a["of"].eqNullSafe(b["rid"]) & a["id"].eqNullSafe(b["doc_id"])
    kept = every.join(gone, match(every, gone), "left_anti")
    again = rows.filter("count > 1").select("doc_id", "rid")
    if not again.isEmpty():
        one = kept.join(again, match(kept, again), "left_semi").dropDuplicates(["id", "of"])
        kept = kept.join(again, match(kept, again), "left_anti").unionByName(one)
    return kept.select("row.*")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, classes = near_copies(read_table(spark, sf_dir, "documents"), 4, 85, 100, named=True)
    names = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    of = settle(classes.join(names, "component").select("fp", "copies", "component_id"), "named")
    return heavy_join(base, of, "fp", "copies").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
