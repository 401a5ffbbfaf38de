"""Physical plans: pruning, single scans, group limits, no accidental nested loops."""

import re

from pyspark.sql import functions as F

from conftest import executed
from creditloom.operators.windows import first_per_key, top_n
from creditloom.plans.apps import app_features
from creditloom.plans.devices import device_features
from creditloom.plans.job_health import job_health_labels
from creditloom.plans.loans import loan_features
from creditloom.sources.scans import scan_dates, scan_window
from workload.standins import ACTION_ANCHOR, LISTS, actions, device_raw, job_run, loan_daily, price

SF = "/root/testdata/sf0.001"


def scans(plan):
    return len(re.findall(r"FileScan|Scan ExistingRDD", plan))


def test_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 AS unused", "date_format(date_add(DATE'2024-01-01', cast(id % 10 AS int)), 'yyyy-MM-dd') AS pt_date").write.partitionBy("pt_date").parquet(path)
    df = spark.read.option("inferSchema", "false").schema("id bigint, unused bigint, pt_date string").parquet(path)
    plan = executed(scan_window(df, "pt_date", "2024-01-05", 2, ["id", "pt_date"]))
    assert re.search(r"PartitionFilters: \[[^\]]*pt_date", plan) and "unused" not in plan
    assert scan_window(df, "pt_date", "2024-01-05", 2).count() == 30
    assert re.search(r"PartitionFilters: \[[^\]]*pt_date", executed(scan_dates(df, "pt_date", ["2024-01-03"])))


def test_loan_features_read_daily_rows_once(spark, tmp_path):
    path = str(tmp_path / "daily")
    loan_daily(spark, SF).write.parquet(path)
    plan = executed(loan_features(spark.read.parquet(path), "1998-06-30"))
    assert scans(plan) == 1
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) == 3
    assert "Join" not in plan and "Expand" not in plan


def test_group_limit_before_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    for frame in (first_per_key(df, ["k"], [F.desc("id")]), top_n(df, ["k"], [F.desc("id")], 100)):
        plan = executed(frame)
        assert plan.count("WindowGroupLimit") == 2


def test_job_health_ranks_no_whole_day(spark, tmp_path):
    path = str(tmp_path / "jobs")
    job_run(spark, SF).write.parquet(path)
    plan = executed(job_health_labels(spark.read.parquet(path), "2024-01-28", 7, (10, 5)))
    assert plan.count("Window [") == plan.count("WindowGroupLimit") / 2
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_messages_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("{}", "device-security", "2024-03-10")], "message string, pt_biz string, pt_date string").write.parquet(path)
    df = app_features(spark.read.parquet(path), "2024-03-20", "2024-03-20", ["a"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_device_features_read_the_log_once(spark, tmp_path):
    for name, frame in (("log", device_raw(spark, SF)), ("actions", actions(spark, SF)), ("price", price(spark, SF))):
        frame.write.parquet(str(tmp_path / name))
    log, acts, prices = (spark.read.parquet(str(tmp_path / n)) for n in ("log", "actions", "price"))
    plan = executed(device_features(log, prices, ACTION_ANCHOR, LISTS, "client_no", acts))
    assert scans(plan) == 3
    # Only the clients' few devices are sorted to find the last one.
    assert plan.count("SortAggregate") <= 2
    assert not re.search(r"SortAggregate\(key=\[device_id", plan)
