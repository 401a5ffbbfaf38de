"""W*, TK* queries."""

from pyspark.sql import functions as F

from creditloom.operators.windows import (
    common_entity,
    daily_top_flags,
    dedup,
    last_entity,
    latest_complete,
    latest_snapshot,
    queue_class,
    rank_per_day,
    top_n,
)
from creditloom.plans.apps import app_entries, parse_messages
from creditloom.plans.devices import latest_price
from creditloom.plans.job_health import PRIORITY_MARKS
from workload.aggregates import used
from workload.base import query, table
from workload.standins import app_log, ev, job_run, price


@query("w1_latest_complete", """
SELECT user_id, event_id, a, b, c FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC,
    (a IS NULL)::INTEGER + (b IS NULL)::INTEGER + (c IS NULL)::INTEGER, ts DESC) AS r
  FROM (SELECT user_id, event_id, ts, CASE WHEN k % 2 = 0 THEN k END AS a, CASE WHEN k % 3 = 0 THEN value END AS b,
          CASE WHEN k % 5 = 0 THEN event_type END AS c FROM ev)) WHERE r = 1""", ["ev"])
def w1(spark, d):
    k = F.col("k")
    rows = ev(spark, d).select(
        "user_id", "event_id", "ts", F.when(k % 2 == 0, k).alias("a"), F.when(k % 3 == 0, F.col("value")).alias("b"),
        F.when(k % 5 == 0, F.col("event_type")).alias("c"),
    )
    return latest_complete(rows, "user_id", "ts").drop("ts")


@query("w2_last_entity", """
SELECT client_no, device_id, days_from_operation FROM (
  SELECT *, row_number() OVER (PARTITION BY client_no ORDER BY days_from_operation, device_id) AS r FROM used)
WHERE r = 1""", ["used"])
def w2(spark, d):
    return last_entity(used(spark, d), "client_no", "days_from_operation", "device_id")


@query("w3_common_entity", """
SELECT client_no, device_id FROM (
  SELECT client_no, device_id, row_number() OVER (PARTITION BY client_no ORDER BY count(*) DESC, device_id) AS r
  FROM used GROUP BY client_no, device_id) WHERE r = 1""", ["used"])
def w3(spark, d):
    return common_entity(used(spark, d), "client_no", "device_id")


@query("w4_latest_price", """
SELECT model, brand, strftime(grass_date, '%Y-%m-%d') AS grass_date, price_usd_median FROM (
  SELECT *, row_number() OVER (PARTITION BY model, brand ORDER BY grass_date DESC, price_usd_median) AS r FROM price)
WHERE r = 1""", ["price"])
def w4(spark, d):
    return latest_price(price(spark, d)).withColumn("grass_date", F.date_format("grass_date", "yyyy-MM-dd"))


@query("w5_latest_snapshot", """
SELECT DISTINCT device_id, app_id, pt_date FROM (
  SELECT *, max(pt_date) OVER (PARTITION BY device_id) AS latest FROM app_all) WHERE pt_date = latest""", ["app_all"])
def w5(spark, d):
    rows = app_entries(parse_messages(app_log(spark, d))).withColumn("pt_date", F.col("pt_date").cast("date"))
    latest = latest_snapshot(rows, "device_id", "pt_date", "app_id")
    return latest.withColumn("pt_date", F.date_format("pt_date", "yyyy-MM-dd"))


@query("w6_dedup_attempts", """
SELECT pt_date, job_id, user_id, strftime(started_date, '%Y-%m-%d %H:%M:%S') AS started FROM (
  SELECT *, row_number() OVER (PARTITION BY pt_date, job_id ORDER BY started_date DESC, user_id) AS r FROM job_run)
WHERE r = 1""", ["job_run"])
def w6(spark, d):
    rows = dedup(job_run(spark, d), ["pt_date", "job_id"], [F.desc("started_date"), F.asc("user_id")])
    return rows.select("pt_date", "job_id", "user_id", F.date_format("started_date", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("w7_rank_per_day", """
SELECT event_id, pt_date, CAST(row_number() OVER (PARTITION BY pt_date
  ORDER BY coalesce(m, 0) DESC, md5(event_id::VARCHAR)) AS INTEGER) AS mu_rank
FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS pt_date, CASE WHEN k % 3 <> 0 THEN value END AS m FROM ev)""", ["ev"])
def w7(spark, d):
    rows = ev(spark, d).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("pt_date"), F.when(F.col("k") % 3 != 0, F.col("value")).alias("m")
    )
    return rank_per_day(rows, "pt_date", "m", "event_id", out="mu_rank").drop("m")


@query("w8_rank_per_day_and_class", """
SELECT event_id, pt_date, CAST(row_number() OVER (PARTITION BY pt_date, q
  ORDER BY coalesce(m, 0) DESC, md5(event_id::VARCHAR)) AS INTEGER) AS rank_in_group
FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS pt_date, CASE WHEN k % 12 <> 0 THEN value END AS m,
        CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END AS q FROM ev)""", ["ev"])
def w8(spark, d):
    k = F.col("k")
    rows = ev(spark, d).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("pt_date"), F.when(k % 12 != 0, F.col("value")).alias("m"),
        F.when(k % 4 == 0, "root.p0").when(k % 4 == 1, "root.P1.x").when(k % 4 == 2, "adhoc").alias("queue"),
    )
    cls = queue_class(F.col("queue"), PRIORITY_MARKS)
    return rank_per_day(rows, "pt_date", "m", "event_id", cls, out="rank_in_group").drop("m", "queue")


_RANKED = """
j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pt_date, job_id ORDER BY started_date DESC, user_id) AS r0
  FROM job_run) WHERE r0 = 1),
c AS (SELECT *, CASE WHEN regexp_matches(lower(app_queue), 'p0|p1') THEN 1 ELSE 0 END AS q FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY pt_date ORDER BY coalesce(memory_gb_hour, 0) DESC, job_id) AS mu,
  row_number() OVER (PARTITION BY pt_date ORDER BY coalesce(elapsed_time_min, 0) DESC, job_id) AS rt,
  row_number() OVER (PARTITION BY pt_date, q ORDER BY coalesce(elapsed_time_min, 0) DESC, job_id) AS rq FROM c)"""


@query("tk1_daily_top_flags", f"WITH {_RANKED} SELECT pt_date, job_id, " + ", ".join(f"""
  CASE WHEN mu <= {k} THEN 1 ELSE 0 END AS mu_top{k}, CASE WHEN rt <= {k} THEN 1 ELSE 0 END AS runtime_top{k},
  CASE WHEN q = 1 AND rq <= {k} THEN 1 ELSE 0 END AS p0_p1_runtime_top{k},
  CASE WHEN q = 0 AND rq <= {k} THEN 1 ELSE 0 END AS non_p0_p1_runtime_top{k}""" for k in (100, 50)) + " FROM r", ["job_run"])
def tk1(spark, d):
    jobs = dedup(job_run(spark, d), ["pt_date", "job_id"], [F.desc("started_date"), F.asc("user_id")])
    jobs = jobs.select("pt_date", "job_id", "app_queue", "memory_gb_hour", "elapsed_time_min")
    priority = queue_class(F.col("app_queue"), PRIORITY_MARKS)
    metrics = {
        "mu": ("memory_gb_hour", None),
        "runtime": ("elapsed_time_min", None),
        "p0_p1_runtime": ("elapsed_time_min", priority == 1),
        "non_p0_p1_runtime": ("elapsed_time_min", priority == 0),
    }
    return daily_top_flags(jobs, "pt_date", "job_id", metrics, [100, 50]).drop(
        "app_queue", "memory_gb_hour", "elapsed_time_min"
    )


@query("tk2_top_n_per_group", """
SELECT l_suppkey, l_orderkey, l_quantity, l_extendedprice, CAST(r AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey) AS r
  FROM lineitem) WHERE r <= 5""")
def tk2(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice")
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), F.asc("l_orderkey")]
    return top_n(rows, ["l_suppkey"], order, 5, "place")


@query("tk3_first_candidates", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def tk3(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return top_n(rows, [], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)
