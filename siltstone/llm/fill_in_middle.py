"""Fill-in-the-middle transformation: DuckDB inside mapInArrow.

Each Arrow batch is registered with an in-process DuckDB connection, cut by one
SQL statement and handed on as Arrow; no text passes through Python row by row.
A text is n units: words with the white space before them, and white space at
its end. Four numbers drawn from the sha256 of "seed:id" choose both cuts, then
whether and in which order the text is rearranged:

    plain  the text
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

A text that holds one of the marks stays plain, so that `restored` can rebuild
every text from its output alone.

A connection lives as long as its task and uses one thread, no disk and at most
MEMORY; batches go to it in slices of about SLICE_BYTES, so memory depends on
the longest text only.

Defined cases: null text = empty text, which is plain with n = 0; a null id is
drawn for as an empty id; repeated rows and ties in the id are transformed
alike, each on its own; very long texts are cut whole; an empty table gives an
empty result; input columns are carried, those named as a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.llm._store import read_table

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SLICE_BYTES, MEMORY = 4 << 20, "700MB"
ADDED = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]


def statement(seed: int, fim_percent: int, spm_percent: int) -> str:
    """SQL over a view `batch` of (id, text), one row out for each row in, in order."""
    draws = ", ".join(f"('0x' || hash[{8 * i + 1}:{8 * i + 8}])::UBIGINT AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    joined = lambda a, b: f"array_to_string(list_slice(units, {a}, {b}), '')"
    return f"""
WITH t AS (SELECT coalesce(text, '') AS text, sha256('{seed}:' || coalesce(id, '')) AS hash FROM batch),
u AS (SELECT text, {draws}, regexp_extract_all(text, '{UNIT}') AS units FROM t),
f AS (SELECT text, units, len(units)::BIGINT AS n, CASE WHEN text = '' OR {marked} OR h3 % 100 >= {fim_percent} THEN 'plain' WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form,
  (least(h1 % (len(units) + 1), h2 % (len(units) + 1)))::BIGINT AS a, (greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)))::BIGINT AS b FROM u),
c AS (SELECT text, n, form, CASE WHEN form <> 'plain' THEN {joined(1, 'a')} END AS prefix, CASE WHEN form <> 'plain' THEN {joined('a + 1', 'b')} END AS middle,
  CASE WHEN form <> 'plain' THEN {joined('b + 1', 'n')} END AS suffix FROM f)
SELECT n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END AS output FROM c"""


def slices(batch: pa.RecordBatch, text: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of about SLICE_BYTES of text, one row at least."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())).to_numpy()
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(ends.searchsorted(before + SLICE_BYTES, side="right")))
        yield lo, hi - lo
        lo = hi


def _cut(key: str, text: str, sql: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        for batch in batches:
            ids, texts = batch.column(key).cast(pa.string()), batch.column(text)
            for lo, size in slices(batch, texts):
                con.register("batch", pa.table({"id": ids.slice(lo, size), "text": texts.slice(lo, size)}))
                found = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("batch")
                columns = [batch.column(c).slice(lo, size) for c in kept] + [found.column(f.name).combine_chunks() for f in ADDED]
                yield pa.record_batch(columns, names=[*kept, *(f.name for f in ADDED)])
        con.close()

    return run


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The rows with n (units), form, prefix_chars and middle_chars (code points, null if plain) and output, the rearranged text."""
    new = {f.name for f in ADDED}
    kept = [f.name for f in docs.schema if f.name not in new or f.name in (key, text)]
    if new & {key, text}:
        raise ValueError(f"the id and text columns must not be named {sorted(new & {key, text})}")
    schema = StructType([docs.schema[c] for c in kept] + ADDED)
    return docs.select(*kept).mapInArrow(_cut(key, text, statement(seed, fim_percent, spm_percent), kept), schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of. A mark in an output is one that was put there, also next to a part that ends or starts like a mark."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
