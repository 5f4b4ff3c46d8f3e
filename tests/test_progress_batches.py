"""R2 over whole batches: the same as the parser, chunk by chunk, and without a step of the parser for each chunk."""

import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from test_progress import chunked, review, told

from siltstone.operators import progress, ranges
from siltstone.operators.progress import MADE, Partial, progressive_findings

BITS = ["{", "}", "[", "]", ",", ":", '"', '"', "\\", '"findings":[', '"findings":[{', '"category":"security"', '"severity":"high"', '"severity":"lo', '{"', '""', "é", '"general"', ",{", "},", '"a":', '{"findings":[', '"find\\u0069ngs":[', "w" * 300]


def spoilt(pick):
    """A review with marks put in or taken out, or marks alone."""
    if pick.random() < 0.4:
        return "".join(pick.choice(BITS) for _ in range(pick.randrange(40)))
    text = review(pick, pick.randrange(6))
    for _ in range(pick.randrange(3)):
        i = pick.randrange(len(text) + 1)
        text = text[:i] + pick.choice(['"', "\\", "{", "}", "[", "]", ",", ":", '""']) + text[i + pick.randrange(2) :]
    return text


def batches(rows, size):
    names, kinds = ("key", "range", "seed", "at", "text"), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string())
    whole = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return iter([whole.slice(i, size) for i in range(0, len(rows), size)])


def walked(rows, size):
    run = ranges._walk_many(progress.TOLD, to_arrow_schema(StructType(MADE)))
    return [tuple(r.values()) for b in run(batches(rows, size)) for r in b.to_pylist()]


@pytest.mark.parametrize("seed", range(16))
def test_batches_give_what_the_parser_gives(seed):
    """Whole and spoilt reviews, from their start or from a state inside them, cut into batches anywhere; null and empty chunks."""
    pick = random.Random(seed)
    rows, expected = [], []
    for key in (None, *range(1, 9)):
        parts = [x for p in chunked(pick, spoilt(pick), pick.choice([2, 5, 40, 200])) for x in ([p, pick.choice([None, ""])] if pick.random() < 0.1 else [p])] or [""]
        made, skipped = told(parts), pick.randrange(len(parts)) if pick.random() < 0.4 else 0
        if skipped:
            state = Partial()
            for text in parts[:skipped]:
                state.feed(text)
            rows.append((key, 0, state.state().encode(), None, None))
        rows += [(key, 0, None, i, text) for i, text in enumerate(parts) if i >= skipped]
        expected += [(key, i, *row) for i, row in enumerate(made) if i >= skipped]
    for size in (pick.choice([17, 40]), 100_000):
        assert walked(rows, size) == expected


@pytest.mark.parametrize("largest", [16_000_000, 120])
def test_large_texts_are_cut_to_few_rows(monkeypatch, largest):
    """Batches with much text are read in pieces, single large chunks by the parser."""
    monkeypatch.setattr(ranges, "BATCH_BYTES", 900)
    monkeypatch.setattr(progress, "LARGEST", largest)
    pick = random.Random(6)
    talks = [chunked(pick, review(pick, 6), size) for size in (300, 20, 700)]
    assert walked([(k, 0, None, i, x) for k, parts in enumerate(talks) for i, x in enumerate(parts)], 1000) == [(k, i, *row) for k, parts in enumerate(talks) for i, row in enumerate(told(parts))]


def test_chunks_of_whole_reviews_need_no_step_of_the_parser(monkeypatch):
    """20,000 chunks of reviews: the parser reads some at the borders of batches only."""
    pick = random.Random(1)
    talks = [chunked(pick, review(pick, 20).replace("\\\\", ""), 40) for _ in range(8)]
    rows = [(k, 0, None, i, text) for k in range(400) for i, text in enumerate(talks[k % 8])]
    fed, feed = [0], Partial.feed
    monkeypatch.setattr(Partial, "feed", lambda self, text: (fed.__setitem__(0, fed[0] + 1), feed(self, text))[1])
    out = walked(rows, 10_000)
    assert len(out) == len(rows) > 20_000 and fed[0] < len(rows) / 100
    expected = [told(t) for t in talks]
    assert [r[2:] for r in out] == [row for k in range(400) for row in expected[k % 8]]


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    """However many rows there are, a task sorts about RANGE_ROWS of them."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    df = spark.range(5_000).selectExpr("id % 700 as key", "id as at", "cast(null as string) as text")
    out = progressive_findings(df, 1_000)
    assert out.rdd.getNumPartitions() >= 50 and out.count() == 5_000


def test_keys_are_counted_where_their_hash_has_many(spark, monkeypatch):
    """Keys that share a hash with others are told apart, hot ones found."""
    monkeypatch.setattr(ranges, "HASHES", 3)
    rows = [(k, i) for k in range(40) for i in range(300 if k in (3, 17) else 20)]
    found = ranges.Ranges(spark.createDataFrame([*rows, *((None, i) for i in range(200))], "key long, at long"), 100)
    assert {k for k, _ in found.cuts} == {3, 17, None} and found.every == 1_560
