"""Streams give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from recordcheck.sources.cache import replay_cache
from recordcheck.streaming.sessions import handed_over, latest_run, progress, stream_cache

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def events(spark, tmp_path):
    """Events in time order, in four files that are read one a batch."""
    rows = spark.read.parquet(EVENTS).orderBy("ts", "event_id")
    pdf = rows.toPandas()
    step = len(pdf) // 4 + 1
    for k in range(4):
        pdf.iloc[k * step : (k + 1) * step].to_parquet(tmp_path / f"{k}.parquet", coerce_timestamps="us")
    schema = spark.read.parquet(str(tmp_path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    query.stop()
    return stream.sparkSession.table(name)


def requests(df):
    kind = F.col("event_type")
    status = F.when(kind == "error", "LOOKUP FAILED").when(kind == "view", "NO RECORD FOUND").otherwise("OK")
    return df.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("request_id"), status.alias("status"))


def test_cache(spark, events):
    got = {r["request_id"]: r["from_cache"] for r in run(stream_cache(requests(events), 86400, 3600), "cache", "append").collect()}
    want = {r["request_id"]: r["from_cache"] for r in replay_cache(requests(spark.read.parquet(EVENTS)), 86400, 3600).collect()}
    assert got == want and any(got.values())


def test_latest_run(spark, events):
    made = lambda df: df.select((F.col("user_id") % 7).alias("entry_id"), F.col("event_id").alias("token"), "event_type").withColumnRenamed("event_type", "result")
    got = {tuple(r) for r in run(latest_run(made(events)), "latest", "complete").collect()}
    assert got == {tuple(r) for r in latest_run(made(spark.read.parquet(EVENTS))).collect()}


def test_progress(spark, events):
    made = lambda df: df.select(F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3).cast("string").alias("source"), F.when(F.col("event_type") == "error", "RATE LIMITED").otherwise("OK").alias("status"))
    got = {tuple(r) for r in run(progress(made(events), "1 day", "1 hour"), "progress", "append").collect()}
    want = {tuple(r) for r in progress(made(spark.read.parquet(EVENTS)), "1 day", "1 hour").collect()}
    assert got and got <= want


def test_handover(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS at, timestamp'2024-01-01 00:04:59' AS now, 'x' AS text UNION ALL SELECT timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:05:01', 'y'")
    assert [r["text"] for r in handed_over(df).collect()] == ["x"]
