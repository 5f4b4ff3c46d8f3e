import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rounded(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value.isoformat() if hasattr(value, "isoformat") else value


def same_rows(spark, query, sql, folder):
    """Hold a query's rows against DuckDB's for the same tables."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = query(spark, folder)
    names = sorted(df.columns)
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    order = [found.index(n) for n in names]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left = sorted((tuple(map(rounded, r)) for r in df.select(*names).collect()), key=key)
    right = sorted((tuple(rounded(r[i]) for i in order) for r in cursor.fetchall()), key=key)
    assert left == right


def drained(spark, start, path, rows, seconds=60):
    """Start a stream that writes to a path, stop it when `rows` rows are there, and give them."""
    import time

    from pyspark.errors import AnalysisException

    query, until, found = start(), time.time() + seconds, []
    try:
        while len(found) < rows and time.time() < until and query.isActive:
            time.sleep(0.5)
            try:
                found = spark.read.parquet(path).collect()
            except AnalysisException:  # nothing is written yet
                pass
    finally:
        query.stop()
    return found
