"""J1 over a corpus: which lines of which artifacts hold which pieces of evidence.

A containment join without pairs of all evidence with all lines. Each piece of
evidence is looked for through one of its 6-byte grams, the one that the texts
hold least often:

1. grams of the texts that any evidence has are counted (a fixed bitmap of
   hashed grams rules out all others where the text is read);
2. each piece of evidence chooses its rarest gram; if that occurs nowhere,
   nothing holds it;
3. positions of chosen grams, each with the bytes around it, are joined with the
   evidence on the gram and compared at their position. Evidence that reaches
   further than those bytes is compared with the text itself, which only
   documents of such candidates are joined for.

Grams are six bytes as a number, so equal numbers are equal grams, and every
comparison is of bytes: the result is exact. Repeated evidence is looked for
once. A gram with at least 1/1000 of all positions is dealt over 64 tasks, its
evidence repeated for each.

Evidence holds over five characters, as for a single finding; shorter, null, or
one with a line end, is held by no line. A null text holds nothing; a null key
is a key. Texts come normalised (`findings.plain_text`); evidence is lowered here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, SLOT_BITS, REACH, COUNT_GRAMS, ROWS_AT_ONCE = 6, 22, 256, 1_000_000, 10_000
HOT_SHARE, SALTS = 1000, 64


def grams(raw: np.ndarray) -> np.ndarray:
    """The gram that starts at each byte, as a number."""
    n = max(len(raw) - GRAM + 1, 0)
    out = np.zeros(n, dtype=np.int64)
    for i in range(GRAM):
        out <<= 8
        out |= raw[i : i + n]
    return out


def slots(gram: np.ndarray) -> np.ndarray:
    return (gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    for i, text in enumerate(batch.column(column)):
        if text.is_valid:
            yield i, np.frombuffer(text.as_buffer(), dtype=np.uint8)


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every gram of every piece of evidence, with the first place it has in it."""
    for batch in batches:
        for i, raw in _texts(batch, "needle"):
            gram, at = np.unique(grams(raw), return_index=True)
            yield pa.record_batch([pa.array([batch.column("id")[i].as_py()] * len(gram), pa.binary()), pa.array(gram), pa.array(at.astype(np.int32)), pa.array(slots(gram).astype(np.int32))], names=["id", "gram", "off", "slot"])


def bitmap(rows: DataFrame):
    """Broadcast flags of the slots that occur in a frame; their number is fixed, so driver and tasks hold 4 MB at most."""
    found = rows.select("slot").distinct().toArrow().column("slot").to_numpy()
    flags = np.zeros(1 << SLOT_BITS, dtype=bool)
    flags[found] = True
    return rows.sparkSession.sparkContext.broadcast(flags)


def _count(flags):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for _, raw in _texts(batch, "text"):
                gram = grams(raw)
                held.append(gram[flags.value[slots(gram)]])
                size += len(held[-1])
                if size >= COUNT_GRAMS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


PLACE = "fp long, gram long, pos int, line long, before int, around binary"


def _places(flags, key: str):
    """Where a text holds a chosen gram, in which line, and what stands around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in _texts(batch, "text"):
                gram = grams(raw)
                found = np.flatnonzero(flags.value[slots(gram)])
                if not len(found):
                    continue
                ends, body = np.flatnonzero(raw == 10), raw.tobytes()
                for lo in range(0, len(found), ROWS_AT_ONCE):
                    at = found[lo : lo + ROWS_AT_ONCE]
                    n = len(at)
                    around = [body[max(p - REACH, 0) : p + GRAM + REACH + 1] for p in at.tolist()]
                    same = pa.array(np.full(n, i))
                    yield pa.record_batch(
                        [batch.column(key).take(same), batch.column("fp").take(same), pa.array(gram[at]), pa.array(at.astype(np.int32)), pa.array(np.searchsorted(ends, at) + 1), pa.array(np.minimum(at, REACH).astype(np.int32)), pa.array(around, pa.binary())],
                        names=[key, *[x.split()[0] for x in PLACE.split(", ")]],
                    )

    return run


def evidence_lines(evidence: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Columns of `evidence` (one is `evidence`), the key of each text that holds it, and the first line that does.

    `texts` has the key and `text`.
    """
    wanted = evidence.filter((F.length("evidence") > 5) & ~F.contains("evidence", F.lit("\n"))).withColumn("needle", F.lower("evidence"))
    needles = wanted.select("needle").distinct().withColumn("id", F.unhex(F.sha2("needle", 256)))
    rows = texts.select(key, "text", F.xxhash64("text").alias("fp"))
    every = needles.mapInArrow(_grams_of, "id binary, gram long, off int, slot int")
    counts = rows.select("text").mapInArrow(_count(bitmap(every)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    best = every.join(counts, "gram", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "off", "slot")).alias("best"))
    probes = best.filter("best.n > 0").join(needles, "id").select("best.*", F.col("needle").cast("binary").alias("needle"))
    probes = probes.persist(StorageLevel.MEMORY_AND_DISK)  # a row for each piece of evidence that may be held
    total = probes.select("gram", "n").distinct().agg(F.sum("n")).first()[0] or 0
    far = (F.col("off") > REACH) | (F.octet_length("needle") - F.col("off") > GRAM + REACH)
    found = [_held(probes.filter(~far), rows, key, total, False)]
    if not probes.filter(far).isEmpty():
        found.append(_held(probes.filter(far), rows, key, total, True))
    lines = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return wanted.join(lines, "needle").groupBy(*evidence.columns, key).agg(F.min("line").alias("line"))


def _held(probes: DataFrame, rows: DataFrame, key: str, total: int, far: bool) -> DataFrame:
    """(needle, key, line) of each text that holds a needle, its first line."""
    kind = rows.schema[key].dataType.simpleString()
    hot = F.col("n") * HOT_SHARE >= total
    salts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    few = F.broadcast(probes.filter(hot).select("gram").distinct().withColumn("hot", F.lit(True)))  # HOT_SHARE grams at most
    places = rows.mapInArrow(_places(bitmap(probes), key), f"{key} {kind}, {PLACE}").join(few, "gram", "left")
    places = places.withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("fp", "pos"), F.lit(SALTS))).otherwise(0))
    met = places.join(probes.withColumn("salt", salts), ["gram", "salt"]).filter("off <= pos")
    size = F.octet_length("needle")
    left = F.least("off", "before")
    right = F.least(size - F.col("off"), F.octet_length("around") - F.col("before"))
    met = met.filter(F.substring("around", F.col("before") - left + 1, left + right) == F.substring("needle", F.col("off") - left + 1, left + right))
    cut = F.col("needle").endswith(F.lit(b"\r"))  # a line's end is no part of it
    if far:
        met = met.drop("around").join(rows.select(F.col(key).alias("_key"), F.col("fp").alias("_fp"), F.col("text").cast("binary").alias("_text")), F.col(key).eqNullSafe(F.col("_key")) & (F.col("fp") == F.col("_fp")))
        start = F.col("pos") - F.col("off") + 1
        met = met.filter((F.substring("_text", start, size) == F.col("needle")) & ~(cut & (F.substring("_text", start + size, F.lit(1)) == F.lit(b"\n"))))
    else:
        met = met.filter((left == F.col("off")) & (right == size - F.col("off")))
        met = met.filter(~(cut & (F.substring("around", F.col("before") + right + 1, F.lit(1)) == F.lit(b"\n"))))
    return met.groupBy("needle", key).agg(F.min("line").alias("line")).withColumn("needle", F.col("needle").cast("string"))
