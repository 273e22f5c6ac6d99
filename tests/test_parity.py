"""Every bound query against its SQL, and the stream against the batch."""

import math
import os

import pytest
from pyspark.sql import functions as F

from groundline.plans import bindings, oracles, portfolio, portfolio_sql
from groundline.streaming.scenes import stream_summary

DATA = "/root/testdata/sf0.001"
QUERIES = {**bindings.QUERIES, **portfolio.QUERIES}
SQL = {**oracles.oracles(), **portfolio_sql.oracles()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(str([normal(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(str([normal(dict(zip(names, r, strict=True))[c]) for c in order]) for r in found.fetchall())
    assert mine == theirs


def test_stream_equals_batch(spark, tmp_path):
    rows = bindings.lines(spark, DATA).select("scene_id", F.col("l_discount").alias("nir"), F.col("l_tax").alias("red"), F.col("l_shipdate").cast("timestamp").alias("ts")).limit(2000)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = stream_summary(spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in")), window="365 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("summaries").start()
    query.processAllAvailable()
    query.stop()
    key = lambda d: {(r.scene_id, r.window.start): r.n for r in d.collect()}
    assert key(spark.table("summaries")) == key(stream_summary(stored, window="365 days"))
