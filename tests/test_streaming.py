"""Streams with state: continuation, late and repeated events, and what a batch writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows, same
from creditloom.operators.windows import first_per_key
from creditloom.streaming.incremental import read_state, stored_state, stream_latest

SCHEMA = "k string, ts timestamp, v string"


@pytest.fixture
def latest(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "changes", "cp"))

    def add(data):
        frame = spark.createDataFrame(data, "k string, ts string, v string")
        frame.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream_latest(stream, ["k"], ["ts", "v"], path, checkpoint).awaitTermination()
        return read_state(spark, path, ["k"])

    run.add, run.path, run.checkpoint, run.source = add, path, checkpoint, source
    return run


def shown(df):
    return rows(df.select("k", F.col("ts").cast("string"), "v"))


def test_stream_latest_continues_from_its_state(spark, latest):
    latest.add([("a", "2024-01-01 10:00:00", "1"), ("a", "2024-01-01 10:00:00", "1"), ("a", "2024-01-01 10:05:00", "2")])
    assert shown(latest()) == [("a", "2024-01-01 10:05:00", "2")]
    latest.add([("a", "2024-01-01 10:04:59", "late"), ("b", "2024-01-01 11:00:00", "4"), (None, None, None)])
    expected = [("a", "2024-01-01 10:05:00", "2"), ("b", "2024-01-01 11:00:00", "4"), (None, None, None)]
    assert shown(latest()) == sorted(expected, key=repr)
    # The late event changed nothing, so only the new keys were written.
    assert shown(spark.read.parquet(f"{latest.path}/version=1")) == sorted(expected[1:], key=repr)
    assert shown(latest()) == sorted(expected, key=repr)
    latest.add([(None, "2024-01-01 00:00:00", None), ("a", "2024-01-01 10:05:00", "3"), ("b", None, "x")])
    expected = [("a", "2024-01-01 10:05:00", "3"), ("b", "2024-01-01 11:00:00", "4"), (None, "2024-01-01 00:00:00", None)]
    assert shown(latest()) == sorted(expected, key=repr)
    assert shown(stored_state(spark, latest.checkpoint, spark.read.parquet(latest.source).schema)) == sorted(expected, key=repr)


def test_a_batch_writes_its_changes_and_not_the_state(spark, latest, tmp_path):
    start = dt.datetime(2024, 1, 1)
    many = [(f"key-{i}", str(start + dt.timedelta(seconds=i)), f"value-{i}") for i in range(30_000)]
    latest.add(many)
    latest()

    def logged(version):
        return sum(p.stat().st_size for p in (tmp_path / "cp" / "state").rglob(f"{version}_*.changelog")) or sum(
            p.stat().st_size for p in (tmp_path / "cp" / "state").rglob(f"{version}.changelog")
        )

    first = logged(1)
    latest.add([("key-7", "2025-01-01 00:00:00", "new"), ("key-x", "2025-01-01 00:00:00", "new")])
    got = latest()
    assert spark.read.parquet(f"{latest.path}/version=1").count() == 2
    assert 0 < logged(2) < first / 50
    every = spark.read.parquet(latest.source)
    same(got, first_per_key(every, ["k"], [F.desc("ts"), F.desc("v")]))
