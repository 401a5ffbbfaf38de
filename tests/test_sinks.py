"""Write, read back, write again: other partitions stay, repeated writes change nothing."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import rows
from creditloom.plans import registry
from creditloom.session import pinned, scratch_path, shared_folder
from creditloom.sources import scans, sinks
from creditloom.streaming.incremental import materialise_day, merge_latest


@pytest.fixture
def table(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    df = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "id int, v string, pt_date string")
    df.write.partitionBy("pt_date").saveAsTable(name)
    yield name
    sinks.drop_table(spark, name)


def read(spark, name):
    return rows(spark.table(name).select("id", "v", "pt_date"))


@pytest.mark.parametrize("times", [1, 2])
def test_replace_partition(spark, table, times):
    new = spark.createDataFrame([("x", 9)], "v string, id int")
    for _ in range(times):
        sinks.replace_partition(new, table, {"pt_date": "d2"})
    assert read(spark, table) == [(1, "a", "d1"), (9, "x", "d2")]


def test_static_partition_is_emptied(spark, table):
    none = spark.createDataFrame([], "id int, v string")
    sinks.insert_overwrite_partition(none, table, {"pt_date": "d2"})
    assert read(spark, table) == [(1, "a", "d1")]


def test_insert_aligned(spark, table):
    sinks.insert_aligned(spark.createDataFrame([("d3", 1.5, "z", 3)], "pt_date string, extra double, v string, id int"), table)
    assert read(spark, table) == [(1, "a", "d1"), (2, "b", "d2"), (3, "z", "d3")]
    with pytest.raises(ValueError, match="lacks: v"):
        sinks.insert_aligned(spark.createDataFrame([(3, "d3")], "id int, pt_date string"), table)


def test_registry_writes_a_new_table(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    apps = spark.createDataFrame([], "client_no string, loan_no string, dc_start_date date, dc_end_date date, application_timestamp long, status string")
    registry.run("ft_failed_application", {"application_scd2": apps}, "2024-03-31", name)
    registry.run("ft_failed_application", {"application_scd2": apps}, "2024-03-31", name)
    assert spark.table(name).count() == 0 and "pt_date" in spark.table(name).columns
    sinks.drop_table(spark, name)
    with pytest.raises(KeyError):
        registry.build("nothing", {}, "2024-03-31")


def test_registry_replaces_the_day_and_empties_it(spark, monkeypatch):
    name = f"t_{uuid.uuid4().hex[:8]}"
    monkeypatch.setitem(registry.REGISTRY, "given", lambda t, anchor, p: t["rows"])
    first = spark.createDataFrame([("a", 1), ("b", 2)], "client_no string, n int")
    registry.run("given", {"rows": first}, "2024-03-31", name)
    registry.run("given", {"rows": first}, "2024-04-30", name)
    registry.run("given", {"rows": first.select("n", "client_no").where("n = 2")}, "2024-04-30", name)
    assert rows(spark.table(name).select("client_no", "n", "pt_date")) == [
        ("a", 1, "2024-03-31"), ("b", 2, "2024-03-31"), ("b", 2, "2024-04-30")
    ]
    registry.run("given", {"rows": first.where("n > 5")}, "2024-03-31", name)
    assert rows(spark.table(name).select("client_no", "pt_date")) == [("b", "2024-04-30")]
    sinks.drop_table(spark, name)


def test_write_partition_drops_its_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1, "d1"), (2, "d1")], "id int, pt_date string")
    target = sinks.write_partition(df, path, {"pt_date": "d1", "biz": "x"}, 2)
    assert target.endswith("/pt_date=d1/biz=x") and spark.read.parquet(target).columns == ["id"]
    assert rows(spark.read.parquet(path).select("id", "pt_date", "biz")) == [(1, "d1", "x"), (2, "d1", "x")]


def test_price_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("model,brand,grass_date,price_usd_median\nm,b,5/3/24,10.5\nm,b,bad,\n")
    got = scans.read_price(spark, str(tmp_path / "p.csv")).select("model", F.col("grass_date").cast("string"), "price_usd_median")
    assert rows(got) == [("m", "2024-03-05", 10.5), ("m", None, None)]


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_folder(spark))
    assert pinned(spark.range(3)).count() == 3


def test_materialise_day_is_repeatable(spark, tmp_path):
    message = '{"deviceId": "a", "deviceInfo": {"os": "x", "apps": ["A,p.q", "A,p.q"]}}'
    log = spark.createDataFrame([(message, "device-security", d) for d in ("2024-03-10", "2024-03-11")], "message string, pt_biz string, pt_date string")
    path = str(tmp_path / "days")
    for day in ("2024-03-10", "2024-03-11", "2024-03-10"):
        materialise_day(log, day, path)
    got = spark.read.parquet(path).withColumn("pt_date", F.col("pt_date").cast("string"))
    assert rows(got.select("device_id", "app_id", "pt_date")) == [("a", "p.q", "2024-03-10"), ("a", "p.q", "2024-03-11")]


def test_merge_latest(spark):
    state = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, ts int, v string")
    today = spark.createDataFrame([("a", 2, "new"), ("b", 4, "old"), ("c", 1, "z")], "k string, ts int, v string")
    once = merge_latest(state, today, ["k"], [F.desc("ts"), F.asc("v")])
    assert rows(once) == [("a", 2, "new"), ("b", 5, "y"), ("c", 1, "z")]
    assert rows(merge_latest(once, today, ["k"], [F.desc("ts"), F.asc("v")])) == rows(once)
