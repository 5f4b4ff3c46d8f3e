"""Merges and states against plain walks, in one range and in many, and as streams."""

import os
import random

import pytest
from conftest import drained

from siltstone.operators.states import EVENTS, STATES, processing_states
from siltstone.operators.store import INITIAL, store_states
from siltstone.sources.readers import write_batches
from siltstone.streaming import live


def patches():
    pick = random.Random(1)
    fields = [*INITIAL, "x", "y"]
    rows = []
    for i in range(900):
        patch = {f: pick.choice([None, "a", f"v{i}"]) for f in pick.sample(fields, pick.randrange(0, 3))}
        rows.append((1 if pick.random() < 0.7 else pick.choice([2, 3, None]), None if i < 3 else pick.randrange(200), i, None if i % 97 == 0 else patch))
    return rows


def in_order(rows, key):
    return sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


def states_by_hand(rows):
    out = {}
    for key in {r[0] for r in rows}:
        state = dict(INITIAL)
        for _, _, seq, patch in in_order(rows, key):
            state |= patch or {}
            out[key, seq] = dict(state)
    return out


@pytest.mark.parametrize("range_rows", [10**6, 50])
def test_store(spark, range_rows):
    df = spark.createDataFrame(patches(), "key long, at long, seq long, patch map<string,string>").repartition(4)
    found = {(r.key, r.seq): r.state for r in store_states(df, range_rows=range_rows).collect()}
    assert found == states_by_hand(patches())


def test_store_tells_null_from_absent(spark):
    df = spark.createDataFrame([(1, 0, 0, {"a": None}), (1, 1, 1, {"b": "x"}), (1, 2, 2, {"a": "y"})], "key long, at long, seq long, patch map<string,string>")
    assert [r.state for r in sorted(store_states(df, initial={}).collect(), key=lambda r: r.at)] == [{"a": None}, {"a": None, "b": "x"}, {"a": "y", "b": "x"}]


def events():
    pick = random.Random(2)
    rows = []
    for i in range(900):
        rows.append((7 if pick.random() < 0.7 else pick.choice([8, None]), None if i < 2 else pick.randrange(500), i, pick.choice([*EVENTS, "step", "step", "step", "odd", None])))
    return rows


def walked(rows):
    out = {}
    for key in {r[0] for r in rows}:
        state, entered = "idle", None
        for _, at, seq, event in in_order(rows, key):
            before = state
            if event == "step" and state not in ("done", "error"):
                state = STATES[STATES.index(state) + 1]
            state = {"read": "reading", "paste": "normalizing", "fail": "error", "reset": "idle"}.get(event, state)
            if event == "staged" and state in ("reading", "normalizing"):
                state = "idle"
            spent = at - entered if state != before and at is not None and entered is not None else None
            entered = at if state != before else entered
            out[key, seq] = (state, before, state != before, entered, spent)
    return out


@pytest.mark.parametrize("range_rows", [10**6, 50])
def test_states(spark, range_rows):
    df = spark.createDataFrame(events(), "key long, at long, seq long, event string").repartition(4)
    found = {(r.key, r.seq): (r.state, r.before, r.changed, r.entered_ms, r.spent_ms) for r in processing_states(df, range_rows=range_rows).collect()}
    assert found == walked(events())


def test_store_stream_and_sink(spark, tmp_path):
    """Patches in three micro-batches, each by a query started anew; then the last batch once more, as after a failure before it was marked as done."""
    import glob

    rows = sorted((r for r in patches() if r[1] is not None), key=lambda r: r[1:3])
    schema = "key long, at long, seq long, patch map<string,string>"

    def run(n):
        stream = live.store_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        return drained(spark, lambda: write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state"), f"{tmp_path}/out", n)

    for batch in range(3):
        spark.createDataFrame([r for r in rows if r[1] * 3 // 200 == batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = run(sum(r[1] * 3 // 200 <= batch for r in rows))
    expected = states_by_hand(rows)
    assert len(found) == len(expected) and {(r.key, r.seq): r.state for r in found} == expected
    for path in sorted(glob.glob(f"{tmp_path}/state/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))[-1:]:
        os.remove(path)
        os.remove(f"{tmp_path}/state/commits/.{os.path.basename(path)}.crc")
    assert len(run(len(expected))) == len(expected)


def test_state_stream_times_out(spark, tmp_path):
    """A stage that has not ended when its time is up becomes an error, told by a row without an event."""
    spark.createDataFrame([(1, 0, 0, "step"), (1, 5, 1, "step"), (2, 0, 2, "read"), (2, 9, 3, "fail")], "key long, at long, seq long, event string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.state_stream(spark.readStream.schema("key long, at long, seq long, event string").parquet(f"{tmp_path}/in"), longest_ms=1500)
    rows = drained(spark, lambda: write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state"), f"{tmp_path}/out", 5)
    told = sorted(((r.key, r.seq is None, r.seq, r.state, r.before, r.spent_ms) for r in rows), key=str)
    assert told == [(1, False, 0, "reading", "idle", None), (1, False, 1, "normalizing", "reading", 5), (1, True, None, "error", "normalizing", None), (2, False, 2, "reading", "idle", None), (2, False, 3, "error", "reading", 9)]
