"""Intermediate tables in the folder that driver and executors share.

Batches of texts that go to Python are bounded by Spark's own
spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set otherwise).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this part of all rows is joined by broadcast; there are never more such keys than this.
HEAVY_SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder given to setCheckpointDir; one of our own on a local master only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = chosen.get() if chosen.isDefined() else getattr(spark, "_siltstone_folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark._siltstone_folder = tempfile.mkdtemp(prefix="siltstone-")
    return folder.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    The written table cuts lineage: a lost executor costs a re-read, not a
    recomputation. For this one write Spark is told to drop the shuffle files
    when it ends, as nothing can read them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)  # what a lazy result still reads goes with the application
    out = spark.read.schema(schema).parquet(path)
    out._siltstone_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove settled tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_siltstone_path", None)
        if path:
            spark = df.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy_join(rows: DataFrame, table: DataFrame, key: str, copies: str) -> DataFrame:
    """rows joined with the table's one row for their key, where `copies` is how many rows the key has.

    Keys with at least 1/1000 of all rows, so at most 1000 of them, are broadcast
    and their rows stay where they are; all others are shuffled. So no task gets
    more than a thousandth of the rows for one key.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) * HEAVY_SHARE >= total
    heavy = F.broadcast(table.filter(hot).drop(copies))
    spread = rows.join(F.broadcast(table.filter(hot).select(key)), key, "left_anti").join(table.filter(~hot).drop(copies), key, "left")
    return rows.join(heavy, key).unionByName(spread)
