"""Requests for each key in a fixed window that starts at the key's first request."""

from __future__ import annotations

import bisect
import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from siltstone.operators.ranges import RANGE_ROWS, Fold, Ranges
from siltstone.rules import limits as R


def verdict_schema(requests: DataFrame) -> StructType:
    """key and request_id as they come in, at_ms, allowed, remaining and retry_after_ms."""
    given = requests.schema
    out = StructType().add("key", given["key"].dataType).add("at_ms", LongType()).add("request_id", given["request_id"].dataType)
    return out.add("allowed", BooleanType()).add("remaining", IntegerType()).add("retry_after_ms", LongType())


def judge(at: np.ndarray, start: int | None, count: int, window: int, most: int):
    """Verdicts on one key's requests in time order, a window at a time, and the state after them: its start and count."""
    allowed, remaining, retry = np.zeros(len(at), bool), np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
    i = 0
    while i < len(at):
        if start is None or at[i] - start >= window:
            start, count = int(at[i]), 0
        end = int(np.searchsorted(at, start + window))
        some = min(end - i, max(most - count, 0))
        allowed[i : i + some] = True
        remaining[i : i + some] = most - count - 1 - np.arange(some)
        retry[i + some : end] = window - (at[i + some : end] - start)
        count += some
        i = end
    return allowed, remaining, retry, start, count


def _starts(keys: pa.Array) -> np.ndarray:
    """Where a run of equal keys starts; a null equals a null."""
    a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(np.concatenate(([True], ~same.to_numpy(zero_copy_only=False))))


def _fold(window: int, most: int):
    """Walk requests sorted by key and time; the only state is the last key's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, count, any_ = None, None, 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, timed = batch.column("key"), batch.column("at_ms").is_valid().to_numpy(zero_copy_only=False)
            at = pc.fill_null(batch.column("at_ms"), 0).to_numpy()
            out = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int64)
            cut = _starts(keys)
            for lo, hi in zip(cut.tolist(), [*cut.tolist(), n][1:], strict=True):
                key = keys[lo].as_py()
                if lo or not any_ or key != last:
                    start, count = None, 0
                last, any_ = key, True
                lo += int((~timed[lo:hi]).sum())  # those without a time come first
                *found, start, count = judge(at[lo:hi], start, count, window, most)
                for column, part in zip(out, found, strict=True):
                    column[lo:hi] = part
            yield pa.record_batch([*(batch.column(c) for c in ("key", "at_ms", "request_id")), *(pa.array(c, mask=~timed) for c in out)], names=["key", "at_ms", "request_id", "allowed", "remaining", "retry_after_ms"])

    return run


class _Chains:
    """Where the windows of a range lead, for every request that may open the range's first one.

    A window that is open when the range starts ends within a window's length of
    the range's first request, so only requests up to there, and the first one
    after, can follow it. Each of these starts a chain of windows; chains that
    meet go on as one. Held are those candidates and one open window for each
    chain, whatever the range's length.
    """

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.rows, self.now, self.edge, self.closed = 0, None, None, False
        self.times, self.before, self.parent, self.open = [], [], [], deque()

    def step(self, at: int | None) -> None:
        if at is None:
            return
        if at != self.now:
            self.now = at
            self.edge = at + self.window if self.edge is None else self.edge
            group = None
            while self.open and self.open[0][0] + self.window <= at:
                ended = self.open.popleft()[2]
                if group is None:
                    group = ended
                else:
                    self.parent[ended] = group
            if not self.closed:
                self.closed = at >= self.edge
                self.times.append(at)
                self.before.append(self.rows)
                self.parent.append(len(self.parent) if group is None else group)
                group = self.parent[-1]
            if group is not None:
                self.open.append((at, self.rows, group))
        self.rows += 1

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def table(self, most_candidates: int) -> bytes:
        if len(self.times) > most_candidates:
            return b""
        left = {g: (start, min(self.rows - before, self.most)) for start, before, g in self.open}
        return json.dumps([self.rows, self.times, self.before, [left[self._root(i)] for i in range(len(self.times))]]).encode()


def _left(table: bytes, state: list | None, window: int, most: int) -> list:
    """The window that is open when a range ends, from the one that was when it began."""
    rows, times, before, left = json.loads(table)
    if state is None:
        return left[0]
    i = bisect.bisect_left(times, state[0] + window)
    return [state[0], min(state[1] + rows, most)] if i == len(times) else left[i]


def _judged(state: list, at: int | None, window: int, most: int) -> tuple:
    if at is None:
        return None, None, None
    if state[0] is None or at - state[0] >= window:
        state[:] = at, 0
    if state[1] < most:
        state[1] += 1
        return True, most - state[1], 0
    return False, 0, window - (at - state[0])


def _in_ranges(ranges: Ranges, window: int, most: int, most_candidates: int) -> DataFrame:
    order, reads = ["at", "request_id"], ["at"]
    opened = lambda seed: json.loads(seed) if seed else [None, 0]
    follow = Fold(order, reads, ["at", "request_id"], opened, lambda s, at: _judged(s, at, window, most), lambda s: json.dumps(s).encode())
    tables = ranges.summaries(Fold(order, reads, [], lambda seed: _Chains(window, most), _Chains.step, lambda c: c.table(most_candidates)))
    entry, walked, todo = {}, {}, ranges.places()
    while todo:
        known = []
        for key, r in todo:
            if r == 0:
                entry[key, r] = None
            elif (key, r - 1) in walked:
                entry[key, r] = walked[key, r - 1]
            elif (key, r - 1) in entry and tables.get((key, r - 1), b"[0]") != b"":
                table = tables.get((key, r - 1))
                entry[key, r] = entry[key, r - 1] if table is None or table.startswith(b"[0,") else _left(table, entry[key, r - 1], window, most)
            if (key, r) in entry and tables.get((key, r)) == b"":
                known.append((key, r))
        todo = [p for p in todo if p not in entry]
        if known:  # ranges with too many candidates for a table: walked from the window that is now known
            seeds = {p: json.dumps(entry[p] or [None, 0]).encode() for p in known}
            walked |= {p: json.loads(s) for p, s in ranges.summaries(follow, seeds, set(known)).items()}
    made = [StructField("allowed", BooleanType()), StructField("remaining", IntegerType()), StructField("retry_after_ms", LongType())]
    return ranges.walk(follow, made, {p: json.dumps(s).encode() for p, s in entry.items() if s is not None}).withColumnRenamed("at", "at_ms")


def rate_limit(requests: DataFrame, window_ms: int = R.WINDOW_MS, most: int = R.MAX_REQUESTS, range_rows: int = RANGE_ROWS, most_candidates: int = 20_000) -> DataFrame:
    """R1 in batch over (key, at_ms, request_id); ties in time by request_id.

    Keys may be of any type that can be ordered. Null keys are one key of their
    own; a request without a time has no verdict (nulls) and is not counted.
    A key's requests depend on each other in order: they stream through a sorted
    partition with constant state. A key with more than its share of all
    requests is cut into ranges of time, at least a window long. Every range is
    first summed up by itself: which window is open at its end, for each request
    that may open its first one. Following these tables gives the window that is
    open where each range begins, and all ranges are judged at once. A range
    with more than most_candidates such requests is walked from its entry.
    """
    ranges = Ranges(requests.select("key", F.col("at_ms").cast("long").alias("at"), "request_id"), range_rows, least_width=window_ms)
    if ranges.hot:
        return _in_ranges(ranges, window_ms, most, most_candidates)
    ordered = requests.select("key", F.col("at_ms").cast("long").alias("at_ms"), "request_id").repartition("key").sortWithinPartitions("key", F.col("at_ms").asc_nulls_first(), "request_id")
    return ordered.mapInArrow(_fold(window_ms, most), verdict_schema(requests))


def retry_after_seconds(retry_ms):
    return F.ceil(retry_ms / F.lit(1000.0))
