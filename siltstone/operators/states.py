"""The processing states of a review, and the time spent in each.

An event is a function from the eight states to the eight states. Functions
compose associatively, with the time of the last change beside each entry: a
review with a large part of all events is cut into ranges, every range composes
its events once for each state it may start in, and states are then read off in
all ranges at once.

    step    on to the next stage; done and error stay
    read    a file is being read, from any state
    paste   a pasted text is being normalised, from any state
    staged  reading or normalising ends in idle
    fail    error, from any state
    reset   idle, from any state

Defined cases: an unknown or null event changes nothing; a null time counts as
no time (durations from or to it are null) and comes first; a null key is one
review; events of one time are taken in the order of `seq`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField

from siltstone.operators.ranges import RANGE_ROWS, Fold, Ranges

#: The order of a review's states.
STATES = ["idle", "reading", "normalizing", "understanding", "grounding", "reasoning", "done", "error"]
IDLE, READING, NORMALIZING, ERROR = 0, 1, 2, 7
#: For each event the state that follows each state.
EVENTS = {
    "step": [1, 2, 3, 4, 5, 6, 6, 7], "read": [READING] * 8, "paste": [NORMALIZING] * 8,
    "staged": [0, IDLE, IDLE, 3, 4, 5, 6, 7], "fail": [ERROR] * 8, "reset": [IDLE] * 8,
}
SAME = list(range(8))
MADE = [StructField("state", StringType()), StructField("before", StringType()), StructField("changed", BooleanType()), StructField("entered_ms", LongType()), StructField("spent_ms", LongType())]


def moved(state: list, event: str | None, at: int | None) -> tuple:
    """One event: state is [number, time entered], changed in place."""
    before, entered = state
    after = EVENTS.get(event, SAME)[before]
    changed = after != before
    if changed:
        state[:] = after, at
    spent = at - entered if changed and at is not None and entered is not None else None
    return STATES[after], STATES[before], changed, state[1], spent


def _compose(rows: list, event: str | None, at: int | None) -> None:
    to = EVENTS.get(event, SAME)
    for row in rows:
        if to[row[0]] != row[0]:
            row[:] = to[row[0]], at, True


def _then(first: bytes, then: bytes) -> bytes:
    """Each row: the state left, the time it was entered, whether it was entered in the range at all."""
    a, b = json.loads(first), json.loads(then)
    return json.dumps([b[s] if b[s][2] else [b[s][0], at, was] for s, at, was in a]).encode()


def processing_states(events: DataFrame, initial: str = "idle", range_rows: int = RANGE_ROWS) -> DataFrame:
    """For every (key, at, seq, event), at in milliseconds: state, the state before, whether it changed, since when it holds, and the time that the state left was held."""
    first, order = STATES.index(initial), ["at", "seq"]
    rows = events.select("key", F.col("at").cast("long").alias("at"), "seq", "event")
    ranges = Ranges(rows, range_rows)
    before = ranges.prefixes(Fold(order, ["event", "at"], [], lambda seed: [[s, None, False] for s in range(8)], _compose, lambda s: json.dumps(s).encode()), _then)
    told = Fold(order, ["event", "at"], ["at", "seq"], lambda seed: json.loads(seed)[first][:2] if seed else [first, None], moved)
    return ranges.walk(told, MADE, before)
