"""The training-data pipeline: from documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
it as Parquet to the shared folder and reads it again as the next stage's docs.
The first four return the columns of documents:

1. quality rules: rejected documents go;
2. n-gram Jaccard join (five words, similarity 0.8): one document of each group stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scans: every span found is replaced by [SECRET], n_chars follows;
5. best-fit packing: token pieces with their sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm._store import discard, read_table, settle
from siltstone.llm.decontamination import decontaminate
from siltstone.llm.jaccard_join import drop_near_copies
from siltstone.llm.packing import pack, token_pieces
from siltstone.llm.quality_rules import quality_rules
from siltstone.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, size=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs, count="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(settle(token_pieces(docs), "pieces"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: Divergence verdicts, tokenisation and packing have no SQL form; tests hold run() against a chain of plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
