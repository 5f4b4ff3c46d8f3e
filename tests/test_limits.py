"""R1 with a key that holds nearly all requests, cut into ranges, against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators.limits import rate_limit
from siltstone.operators.ranges import Ranges


def requests(seed, span):
    pick = random.Random(seed)
    rows = []
    for i in range(1500):
        at = pick.randrange(span) if pick.random() < 0.8 else span // 2 + pick.randrange(20)
        rows.append(("hot" if pick.random() < 0.9 else pick.choice(["a", None]), None if i % 211 == 0 else at, i))
    return rows


def walked(rows, window, most):
    out = {}
    for key in {r[0] for r in rows}:
        start, count = None, 0
        for _, at, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            if at is None:
                out[i] = (key, at, None, None, None)
                continue
            if start is None or at - start >= window:
                start, count = at, 0
            ok = count < most
            count += ok
            out[i] = (key, at, ok, most - count if ok else 0, 0 if ok else window - (at - start))
    return out


@pytest.mark.parametrize("seed, span, window, most, candidates", [(1, 3000, 40, 3, 10**6), (2, 3000, 40, 3, 0), (3, 100_000, 60, 1, 10**6), (4, 900, 100, 50, 30), (5, 50_000, 5, 2, 10**6), (6, 600, 200, 4, 10**6)])
def test_ranges_give_what_a_walk_gives(spark, seed, span, window, most, candidates):
    rows = requests(seed, span)
    df = spark.createDataFrame(rows, "key string, at_ms long, request_id long").repartition(4)
    out = rate_limit(df, window, most, range_rows=60, most_candidates=candidates)
    assert out.columns == ["key", "at_ms", "request_id", "allowed", "remaining", "retry_after_ms"]
    assert {r.request_id: (r.key, r.at_ms, r.allowed, r.remaining, r.retry_after_ms) for r in out.collect()} == walked(rows, window, most)


def test_no_task_holds_the_hot_key(spark):
    df = spark.createDataFrame(requests(1, 30_000), "key string, at_ms long, request_id long").select("key", F.col("at_ms").alias("at"), "request_id")
    sizes = [r["count"] for r in Ranges(df, 60, least_width=40).rows.filter("key = 'hot' and at is not null").groupBy("range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 600
