"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal.

A text is cut into tokens (runs of letters and digits, runs of other visible
characters); the hashed one- and two-token n-grams, weighted by their share of
the text, are the features. Weights are learned with follow-the-regularised-
leader updates, one document at a time, over a bounded sample of the labelled
documents: the `MAX_TRAIN` ones whose hashed id is smallest. Every document is
scored as a sparse dot product in vectorised batches.

Only the text is an input of a score. Labels are read from training rows only.

Defined cases: a null or empty text has no features and gets the score of the
bias; a label row without document, or with a null label or id, is not used; a
document labelled twice counts once for each row; without any usable label the
score is 0.5 for all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._store import read_table
from siltstone.llm._text import SPACE, chunks, combine, crc_remainder, prefix_hash, runs, span_hash

BITS, EPOCHS, MAX_TRAIN = 18, 4, 6_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.0005, 0.01
SCALE = 30.0
THRESHOLD = 0.3

KIND = np.full(256, 2, dtype=np.uint8)
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1
KIND[SPACE] = 0


class Tokens:
    """Maximal runs of one kind of byte, within documents."""

    def __init__(self, chunk):
        kind = KIND[chunk.data]
        n = len(kind)
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = kind[1:] != kind[:-1]
        edge[chunk.offsets[chunk.offsets < n]] = True
        cut = np.flatnonzero(edge)
        if n:
            keep = kind[cut[:-1]] != 0
            self.start, self.end = cut[:-1][keep], cut[1:][keep]
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.bounds = np.searchsorted(self.start, chunk.offsets)


def features(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the document of each, ordered by document."""
    tokens = Tokens(chunk)
    one = span_hash(prefix_hash(chunk.data), tokens.start, tokens.end)
    docs = np.repeat(np.arange(len(chunk)), np.diff(tokens.bounds))
    starts, pair_docs = runs(tokens.bounds, 2)
    two = combine(one, 2)[starts] if len(starts) else one[:0]
    where = np.concatenate((docs, pair_docs))
    order = np.argsort(where, kind="stable")
    return (np.concatenate((one, two)) & np.uint64((1 << BITS) - 1)).astype(np.int64)[order], where[order]


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights; the last entry is the bias."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for index, value, label in examples:
            zi, ni = z[index], n[index]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            w[index] = wi
            p = 1 / (1 + np.exp(-np.clip(wi @ value, -30, 30)))
            g = (p - label) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[index] = zi + g - step * wi
            n[index] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        labels, order = batch.column("quality").to_pylist(), batch.column("order").to_pylist()
        for chunk in chunks(batch.column("text")):
            index, docs = features(chunk)
            for i, part in enumerate(np.split(index, np.searchsorted(docs, np.arange(1, len(chunk))))):
                key, count = np.unique(part, return_counts=True)
                value = np.append(SCALE * count / max(len(part), 1), 1.0)
                held.append((order[chunk.lo + i], (np.append(key, 1 << BITS), value, labels[chunk.lo + i])))
    held.sort(key=lambda x: x[0])
    yield pa.record_batch([pa.array([fit([x for _, x in held]).tobytes() if held else b""], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, held_out_remainder: int | None = 0, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from at most max_train labelled documents. They are found by all tasks and sent to one, whose input is so bounded."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    if held_out_remainder is not None:
        usable = usable.filter(crc != held_out_remainder)
    usable = usable.filter(F.col("quality").isin(0, 1)).withColumn("order", F.xxhash64("doc_id", F.lit(17)))
    chosen = usable.orderBy("order", "doc_id", "quality").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "order")
    rows = sample.repartition(1).mapInArrow(_train, "weights binary").collect()
    found = [r.weights for r in rows if r.weights]
    return np.frombuffer(bytes(found[0]), dtype=np.float32) if found else np.zeros((1 << BITS) + 1, dtype=np.float32)


def predict(chunk, weights: np.ndarray) -> np.ndarray:
    index, docs = features(chunk)
    total = np.bincount(docs, weights=weights[index], minlength=len(chunk))
    count = np.bincount(docs, minlength=len(chunk))
    return 1 / (1 + np.exp(-np.clip(SCALE * total / np.maximum(count, 1) + weights[-1], -30, 30)))


def _score(weights, text: str, carry: bool, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.astype(np.float64)
        for batch in batches:
            score = np.concatenate([predict(c, w) for c in chunks(batch.column(text))] or [np.zeros(0)])
            if carry:
                yield pa.record_batch([*batch.columns, pa.array(score)], names=[*batch.schema.names, "quality_score"])
            else:
                held = crc_remainder(batch.column("doc_id").to_pylist()) == 0
                yield pa.record_batch([batch.column("doc_id"), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of docs, and quality_score (an input column of that name is replaced)."""
    from pyspark.sql.types import DoubleType, StructType

    docs = docs.drop("quality_score")
    schema = StructType([*docs.schema.fields]).add("quality_score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(_score(shared, text, True, THRESHOLD), schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = spark.sparkContext.broadcast(train(docs, read_table(spark, sf_dir, "labels")))
    return docs.mapInArrow(_score(weights, "text", False, THRESHOLD), "doc_id long, held_out boolean, score double, predicted int")
