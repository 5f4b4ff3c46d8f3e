"""Structured Streaming: the request limiter, growing reviews, live finding scores, run-once reviews, stores and processing states."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.operators.findings import deduction
from siltstone.operators.limits import judge, verdict_schema
from siltstone.operators.progress import MADE, Partial
from siltstone.operators.states import MADE as STATE_COLUMNS
from siltstone.operators.states import STATES, moved
from siltstone.operators.store import INITIAL, PATCH, merged
from siltstone.rules import limits as R


DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keeps_values(df: DataFrame) -> None:
    """transformWithState needs a store that holds several named values: set for the session, unless one is chosen there."""
    name = "spark.sql.streaming.stateStore.providerClass"
    conf = df.sparkSession.conf
    if conf.get(name, "").endswith("HDFSBackedStateStoreProvider") or not conf.get(name, ""):
        conf.set(name, ROCKS)


class _Limits(StatefulProcessor):
    """A key's window: its start and count. It goes when the window is over and no late request can be of it."""

    def __init__(self, names: list[str], window_ms: int, most: int, late_ms: int):
        self.names, self.window_ms, self.most, self.late_ms = names, window_ms, most, late_ms

    def init(self, handle) -> None:
        self.value = handle.getValueState("window", "start long, count long", self.window_ms + self.late_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, count = self.value.get() if self.value.exists() else (None, 0)
        for frame in rows:
            frame = frame.sort_values(["at_ms", "request_id"])
            none, frame = frame[frame["at_ms"].isna()], frame[frame["at_ms"].notna()]
            allowed, remaining, retry, start, count = judge(frame["at_ms"].to_numpy(np.int64), start, count, self.window_ms, self.most)
            yield frame.assign(allowed=allowed, remaining=remaining, retry_after_ms=retry)[self.names]
            if len(none):
                yield none.assign(allowed=None, remaining=None, retry_after_ms=None)[self.names]
        if start is not None:
            self.value.update((start, count))

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, window_ms: int = R.WINDOW_MS, most: int = R.MAX_REQUESTS, late_ms: int = 600_000) -> DataFrame:
    """R1 on a stream of (key, at_ms, request_id): state is the window's start and count, one pair for each key, and expires.

    Requests are judged as they arrive, a frame at a time, each frame in the
    order of (at_ms, request_id); one without a time has no verdict. A request
    older than the window that is open counts in it. State is kept for a window
    and late_ms after a key's last request: a request that comes more than
    late_ms after its time may open a window anew.
    """
    keeps_values(requests)
    schema = verdict_schema(requests)
    rows = requests.select("key", F.col("at_ms").cast("long").alias("at_ms"), "request_id")
    return rows.groupBy("key").transformWithStateInPandas(_Limits(schema.names, window_ms, most, late_ms), schema, "Append", "ProcessingTime")


class _Reviews(StatefulProcessor):
    """The parser's state of each review, a bounded text; it goes a while after the review's last chunk."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.value = handle.getValueState("review", "state string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = Partial(self.value.get()[0] if self.value.exists() else None)
        for frame in rows:
            told = [state.feed(None if t is None or t != t else t).counts() for t in frame["text"]]
            out = pd.DataFrame(told, columns=[f.name for f in MADE])
            out.insert(0, "at", frame["at"].to_numpy())
            out.insert(0, "key", [key[0]] * len(out))
            yield out
        self.value.update((state.state(),))

    def close(self) -> None:
        pass


def progressive_stream(chunks: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """R2 on a stream of (key, at, text): after every chunk what `progressive_findings` gives, each chunk read once.

    A later row of a review replaces its earlier ones: findings that change are
    taken back by it. Chunks of a review are read as they arrive, a frame at a
    time; a review's state expires ttl_ms after its last chunk.
    """
    keeps_values(chunks)
    given = chunks.schema
    schema = StructType([StructField("key", given["key"].dataType), StructField("at", given["at"].dataType), *MADE])
    return chunks.select("key", "at", "text").groupBy("key").transformWithStateInPandas(_Reviews(ttl_ms), schema, "Append", "ProcessingTime")


def live_scores(findings: DataFrame) -> DataFrame:
    """R2: score and counts of each artifact as findings arrive (update mode)."""
    kinds = lambda *names: F.count_if(F.col("category").isin(*names))
    out = findings.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("n_findings"), F.greatest(F.lit(R.LEAST_SCORE), 100 - F.sum(deduction(F.col("severity")))).cast("int").alias("score"),
        kinds("architecture", "maintainability", "general").alias("arch_count"), kinds("security").alias("sec_count"), kinds("scalability", "performance").alias("scale_count"),
    )
    return out


def run_once(reviews: DataFrame, at: str | None = None, within: str = "1 day") -> DataFrame:
    """A review that was seen is not run again. With a time column `at` on a stream, reviews seen longer than `within` ago are forgotten, and later ones of that age are dropped; without, every review is remembered."""
    if at is None:
        return reviews.dropDuplicates(["artifact_id"])
    return reviews.withWatermark(at, within).dropDuplicatesWithinWatermark(["artifact_id"])


class _Stores(StatefulProcessor):
    """The state of each store as one text; it goes a while after its last patch."""

    def __init__(self, initial: dict, ttl_ms: int):
        self.initial, self.ttl_ms = initial, ttl_ms

    def init(self, handle) -> None:
        self.value = handle.getValueState("store", "state string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.value.get()[0]) if self.value.exists() else dict(self.initial)
        for frame in rows:
            told = [sorted(merged(state, json.loads(p) if isinstance(p, str) else None).items()) for p in frame["patch"]]
            out = pd.DataFrame({"at": frame["at"].to_numpy(), "seq": frame["seq"].to_numpy(), "state": [json.dumps(dict(s)) for s in told]})
            out.insert(0, "key", [key[0]] * len(out))
            yield out
        self.value.update((json.dumps(state),))

    def close(self) -> None:
        pass


def store_stream(patches: DataFrame, initial: dict | None = None, ttl_ms: int = DAY_MS) -> DataFrame:
    """S5 on a stream of (key, at, seq, patch): the state after each patch, in the order of arrival."""
    keeps_values(patches)
    given = patches.schema
    schema = StructType([StructField("key", given["key"].dataType), StructField("at", given["at"].dataType), StructField("seq", given["seq"].dataType), StructField("state", StringType())])
    rows = patches.select("key", "at", "seq", F.to_json(F.col("patch").cast(PATCH), {"ignoreNullFields": "false"}).alias("patch"))
    out = rows.groupBy("key").transformWithStateInPandas(_Stores(dict(INITIAL if initial is None else initial), ttl_ms), schema, "Append", "ProcessingTime")
    return out.withColumn("state", F.from_json("state", PATCH))


class _States(StatefulProcessor):
    """State and time entered of each review, and a timer for the stage it is in."""

    def __init__(self, longest_ms: int):
        self.longest_ms = longest_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", "state int, entered long")

    def _restart(self, now: int, running: bool) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if running:
            self.handle.registerTimer(now + self.longest_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.value.get()) if self.value.exists() else [0, None]
        for frame in rows:
            told = [moved(state, e, None if t is None or t != t else int(t)) for e, t in zip(frame["event"], frame["at"], strict=True)]
            out = pd.DataFrame(told, columns=[f.name for f in STATE_COLUMNS])
            out.insert(0, "seq", frame["seq"].to_numpy())
            out.insert(0, "at", frame["at"].to_numpy())
            out.insert(0, "key", [key[0]] * len(out))
            yield out
        ended = STATES[state[0]] in ("idle", "done", "error")
        if STATES[state[0]] == "idle" and state[1] is None:
            self.value.clear()
        else:
            self.value.update(tuple(state))
        self._restart(timerValues.getCurrentProcessingTimeInMs(), not ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            before = STATES[self.value.get()[0]]
            self.value.clear()
            yield pd.DataFrame({"key": [key[0]], "at": [None], "seq": [None], "state": ["error"], "before": [before], "changed": [True], "entered_ms": [None], "spent_ms": [None]})

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, longest_ms: int = 60_000) -> DataFrame:
    """R4 on a stream of (key, at, seq, event): what `processing_states` gives for each event, in the order of arrival. A stage that lasts longer than longest_ms without an event becomes an error and is forgotten; that row has no at and seq."""
    keeps_values(events)
    given = events.schema
    schema = StructType([StructField("key", given["key"].dataType), StructField("at", LongType()), StructField("seq", given["seq"].dataType), *STATE_COLUMNS])
    return events.select("key", F.col("at").cast("long").alias("at"), "seq", "event").groupBy("key").transformWithStateInPandas(_States(longest_ms), schema, "Append", "ProcessingTime")


def next_state(state):
    """The state after a finished step; done and error stay."""
    out = None
    for a, b in zip(STATES[:6], STATES[1:7], strict=True):
        out = F.when(state == a, b) if out is None else out.when(state == a, b)
    return out.otherwise(state)
