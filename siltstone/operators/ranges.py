"""Folds over the rows of a key in order, also for a key that holds a large part of all rows.

A fold walks a key's rows sorted and keeps a small state. A key with more rows
than a task should get is cut into ranges of its order: the fold runs first over
each range by itself to a summary, summaries of earlier ranges are combined into
the state a range starts from (its seed), and the last pass walks all ranges at
once, each from its seed. There are at most MAX_RANGES ranges in all, whatever
the data: that bounds the broadcast of their cuts and what the driver combines.

Cuts are values, collected once: every later pass, and every task that is run
again after an executor is lost, deals the same rows to the same range. Rows of
one key and one order value stay together. To find keys with many rows, rows are
counted by a hash of the key; only where a hash has too many are keys counted.

Rows are sorted in tasks of about RANGE_ROWS rows, however many there are in all.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

MAX_RANGES, RANGE_ROWS = 1024, 1_000_000
#: Hashes by which rows are counted; many times MAX_RANGES, so that one with more rows than a range should have holds a hot key nearly always.
HASHES = 64 * MAX_RANGES

#: What the steps of many rows at once are given, so that what they make of it stays small; more is cut, to single rows.
BATCH_BYTES = 4_000_000

#: (key, range) to what its state starts from.
Seeds = dict[tuple[Any, int], bytes]


class Ranges:
    """Rows of (key, at, ...), with their range if any key has several (`hot`)."""

    def __init__(self, rows: DataFrame, range_rows: int = RANGE_ROWS, least_width: float | None = None):
        self.key = StructField("key", rows.schema["key"].dataType)
        self.cuts, self.every = _cuts(rows, range_rows, least_width)
        self.hot = bool(self.cuts)
        self.rows = self._with_range(rows) if self.hot else rows

    def _with_range(self, rows: DataFrame) -> DataFrame:
        kind = ArrayType(ArrayType(rows.schema["at"].dataType))
        table = rows.sparkSession.createDataFrame([(k, _two_levels(c)) for k, c in self.cuts], StructType([StructField("hot_key", self.key.dataType), StructField("cuts", kind)]))
        joined = rows.join(F.broadcast(table), F.col("key").eqNullSafe(F.col("hot_key")), "left")
        below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("at")))
        block = below(F.transform("cuts", lambda b: F.get(b, F.lit(0))))
        number = F.when(block > 0, (block - 1) * F.size(F.get("cuts", F.lit(0))) + below(F.get("cuts", block - 1)))
        return joined.withColumn("range", F.coalesce(F.when(F.col("cuts").isNotNull(), number), F.lit(0))).drop("hot_key", "cuts")

    def hot_rows(self) -> DataFrame:
        return self._only([k for k, _ in self.cuts])

    def _only(self, keys: list) -> DataFrame:
        table = self.rows.sparkSession.createDataFrame([(k,) for k in keys], StructType([StructField("hot_key", self.key.dataType)]))
        return self.rows.join(F.broadcast(table), F.col("key").eqNullSafe(F.col("hot_key")), "left_semi")

    def places(self) -> list[tuple[Any, int]]:
        """Every (key, range) of the hot keys, in order of ranges."""
        return [(k, r) for k, c in self.cuts for r in range(len(c) + 1)]

    def summaries(self, fold: Fold, seeds: Seeds | None = None, only: set[tuple[Any, int]] | None = None) -> Seeds:
        """What each range of the hot keys comes to, from its seed; MAX_RANGES entries at most. A range without rows has none."""
        rows = self.hot_rows()
        if only is not None:
            rows = rows.join(F.broadcast(self._seed_frame({p: b"" for p in only}).drop("seed").withColumnsRenamed({"key": "k2", "range": "r2"})), F.col("key").eqNullSafe(F.col("k2")) & (F.col("range") == F.col("r2")), "left_semi")
            seeds = {p: s for p, s in (seeds or {}).items() if p in only}
        schema = StructType([self.key, StructField("range", IntegerType()), StructField("summary", BinaryType())])
        return {(r.key, r.range): bytes(r.summary) for r in self._sorted(rows, fold, seeds).mapInArrow(_walk(fold, None), schema).collect()}

    def prefixes(self, fold: Fold, combine: Callable[[bytes, bytes], bytes]) -> Seeds:
        """The combined summaries of all earlier ranges, for each range but a key's first."""
        if not self.hot:
            return {}
        found, out, before = self.summaries(fold), {}, {}
        for key, r in self.places():
            if r and key in before:
                out[key, r] = before[key]
            if (key, r) in found:
                before[key] = combine(before[key], found[key, r]) if key in before else found[key, r]
        return out

    def walk(self, fold: Fold, made: list[StructField], seeds: Seeds | None = None) -> DataFrame:
        """(key, the columns that the fold carries, what it makes) for every row."""
        kept = [self.rows.schema[c] for c in fold.carries]
        walk = _walk_many if fold.many else _walk
        return self._sorted(self.rows, fold, seeds).mapInArrow(walk(fold, to_arrow_schema(StructType(made))), StructType([self.key, *kept, *made]))

    def _seed_frame(self, seeds: Seeds) -> DataFrame:
        schema = StructType([self.key, StructField("range", IntegerType()), StructField("seed", BinaryType())])
        return self.rows.sparkSession.createDataFrame([(k, r, s) for (k, r), s in seeds.items()], schema)

    def _sorted(self, rows: DataFrame, fold: Fold, seeds: Seeds | None) -> DataFrame:
        """Rows of a (key, range) together and in order, its seed first; without hot keys there are no ranges and no seeds."""
        columns, order = list(dict.fromkeys([*fold.carries, *fold.reads, *fold.order])), [F.col(c).asc_nulls_first() for c in fold.order]
        tasks = math.ceil(self.every / RANGE_ROWS)
        tasks = (tasks,) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
        if not self.hot:
            return rows.select("key", *columns).repartition(*tasks, "key").sortWithinPartitions("key", *order)
        rows = rows.select("key", "range", F.lit(None).cast("binary").alias("seed"), *columns)
        if seeds:
            rows = rows.unionByName(self._seed_frame(seeds), allowMissingColumns=True)
        return rows.repartition(*tasks, "key", "range").sortWithinPartitions("key", "range", F.col("seed").isNull(), *order)


class Fold:
    """What to keep for each key: open(seed or None) makes a state, step(state, *reads) takes a row in and gives what it makes, close(state) sums a range up.

    `order` names the columns that rows are sorted by, `reads` those that step gets, `carries` those that go on beside what it makes.
    `many`, if given, takes the steps of a whole batch at once: many({group: state that it starts from}, first row of each group, *arrays that it reads) gives
    what is made, a column each, and the state that the last group leaves; a group not named starts from open(None). A seed's row is the first of its group, its columns null.
    """

    def __init__(self, order: list[str], reads: list[str], carries: list[str], open_: Callable, step: Callable, close: Callable | None = None, many: Callable | None = None):
        self.order, self.reads, self.carries, self.open, self.step, self.close, self.many = order, reads, carries, open_, step, close, many


def _walk(fold: Fold, out: pa.Schema | None):
    """Over sorted batches. With a schema: what the fold makes, a row out for each row in. Without: the summary of each (key, range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            made, kept, ended = [], [], []
            keys, ranges, seeds = (batch.column(c).to_pylist() if c in batch.schema.names else itertools.repeat(none, batch.num_rows) for c, none in (("key", None), ("range", 0), ("seed", None)))
            values = zip(*(batch.column(c).to_pylist() for c in fold.reads), strict=True) if fold.reads else ((),) * batch.num_rows
            for i, (key, part, seed, row) in enumerate(zip(keys, ranges, seeds, values, strict=True)):
                if at is None or at[0] != key or at[1] != part:
                    if at is not None and out is None:
                        ended.append((*at, fold.close(state)))
                    at, state = (key, part), fold.open(seed)
                    if seed is not None:
                        continue
                found = fold.step(state, *row)
                if out is not None:
                    kept.append(i)
                    made.append(found)
            if out is None:
                if ended:
                    yield _summary(ended, batch)
            elif kept:
                some = batch.take(pa.array(kept)) if len(kept) < batch.num_rows else batch
                columns = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)]
                yield pa.record_batch([some.column("key"), *(some.column(c) for c in fold.carries), *columns], names=["key", *fold.carries, *out.names])
        if at is not None and out is None:
            yield _summary([(*at, fold.close(state))], batch)

    return run


def _walk_many(fold: Fold, out: pa.Schema):
    """`_walk` with what the fold makes of whole batches; a group that goes on in the next batch starts there from the state it left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in itertools.chain.from_iterable(map(_pieces, batches)):
            names = [c for c in ("key", "range") if c in batch.schema.names]
            place = lambda i: tuple(batch.column(c)[int(i)].as_py() for c in names)  # noqa: B023, E731
            first = np.unique(np.concatenate([_starts(batch.column(c)) for c in names]))
            opened = {0: state} if at == place(0) else {}
            if "seed" in batch.schema.names:
                seeds = batch.column("seed").take(pa.array(first))
                opened |= {int(g): fold.open(seeds[int(g)].as_py()) for g in np.flatnonzero(seeds.is_valid().to_numpy(zero_copy_only=False))}
            made, state = fold.many(opened, first, *(batch.column(c) for c in fold.reads))
            at = place(batch.num_rows - 1)
            found = [batch.column("key"), *(batch.column(c) for c in fold.carries), *(pa.array(c, f.type) for c, f in zip(made, out, strict=True))]
            told = pa.record_batch(found, names=["key", *fold.carries, *out.names])
            yield told.filter(batch.column("seed").is_null()) if "seed" in batch.schema.names else told

    return run


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    half = batch.num_rows // 2
    if half and batch.nbytes > BATCH_BYTES:
        yield from _pieces(batch.slice(0, half))
        yield from _pieces(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _starts(values: pa.Array) -> np.ndarray:
    """Where runs of equal values start; nulls are equal."""
    if pa.types.is_nested(values.type):
        values = values.to_pylist()
        return np.array([i for i, value in enumerate(values) if not i or value != values[i - 1]])
    same = pc.equal(values[1:], values[:-1]).fill_null(False)
    if values.null_count:
        same = pc.or_(same, pc.and_(values[1:].is_null(), values[:-1].is_null()))
    return np.append(0, np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1)


def _summary(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    keys, parts, sums = zip(*rows, strict=True)
    return pa.record_batch([pa.array(keys, like.schema.field("key").type), pa.array(parts, pa.int32()), pa.array(sums, pa.binary())], names=["key", "range", "summary"])


def _two_levels(cuts: list) -> list[list]:
    """Cuts in blocks of about the root of their number, so that a row is compared with a few dozen of them."""
    size = max(1, math.isqrt(len(cuts)))
    return [cuts[i : i + size] for i in range(0, len(cuts), size)]


def _cuts(rows: DataFrame, range_rows: int, least_width: float | None) -> tuple[list[tuple[Any, list]], int]:
    """For each key with more rows than a range should have, the order values at which ranges start; and the number of rows. Counted where rows are, before anything moves."""
    hashed = F.pmod(F.xxhash64("key"), F.lit(HASHES)).cast("int")
    by_hash = rows.groupBy(hashed.alias("hash")).agg(F.count("at").alias("n"))
    every, most = by_hash.agg(F.sum("n"), F.max("n")).first()
    every = every or 0
    limit = max(range_rows, math.ceil(every / MAX_RANGES))
    if not most or most <= limit:
        return [], every
    full = [r.hash for r in by_hash.filter(F.col("n") > limit).select("hash").collect()]  # fewer than MAX_RANGES
    keys = rows.filter(hashed.isin(full)).groupBy("key").agg(F.count("at").alias("n")).filter(F.col("n") > limit)
    hot = F.broadcast(keys.withColumnRenamed("key", "hot_key"))  # fewer than MAX_RANGES
    fractions = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    found = rows.join(hot, F.col("key").eqNullSafe(F.col("hot_key"))).groupBy("key").agg(F.percentile_approx("at", fractions, 20 * MAX_RANGES).alias("at"), F.min("at").alias("least"), F.first("n").alias("n"))
    out = []
    for r in found.collect():
        step, cuts = max(1, math.ceil(MAX_RANGES * limit / r.n)), []
        for c in r.at[step - 1 :: step]:
            if c > (cuts[-1] if cuts else r.least) and (least_width is None or c - (cuts[-1] if cuts else r.least) >= least_width):
                cuts.append(c)
        if cuts:
            out.append((r.key, cuts))
    return out, every
