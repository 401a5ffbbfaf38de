"""Scalar function groups."""

from pyspark.sql import functions as F

from creditloom.functions.columns import ladder, log_odds, to_int
from creditloom.functions.dates import days_ago, feature_date, from_epoch_ms, hour_bucket
from creditloom.functions.packed import (
    app_package,
    battery_part,
    boot_date,
    bytes_to_gib,
    count_char,
    item,
    screen_width,
    storage_gib,
    version_number,
)
from workload.base import query, table
from workload.standins import applications, ev


@query("fn_date", """
SELECT loan_no, strftime(last_day(dc_start_date), '%Y-%m-%d') AS month,
  strftime(make_timestamp(application_timestamp * 1000), '%Y-%m-%d') AS apply_date,
  CAST(date_diff('day', dc_start_date, DATE '1998-06-30') AS INTEGER) AS age,
  (dc_start_date <= DATE '1998-05-31') AS before_feature_date FROM applications""", ["applications"])
def fn_date(spark, d):
    start = F.col("dc_start_date")
    return applications(spark, d).select(
        "loan_no",
        F.date_format(F.last_day(start), "yyyy-MM-dd").alias("month"),
        F.date_format(from_epoch_ms(F.col("application_timestamp")), "yyyy-MM-dd").alias("apply_date"),
        days_ago(start, "1998-06-30").alias("age"),
        (start <= F.lit(feature_date("1998-06-14")).cast("date")).alias("before_feature_date"),
    )


@query("fn_hour_bucket", """
SELECT event_id, '[' || hour(ts) || ', ' || (hour(ts) + 1) || ')' AS bucket FROM events""")
def fn_hour(spark, d):
    return table(spark, d, "events").select("event_id", hour_bucket(F.col("ts")).alias("bucket"))


@query("fn_string", """
SELECT p_partkey, lower(p_brand) AS brand, string_split(p_name, ' ')[2] AS second_word,
  CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INTEGER) AS n_e, p_name LIKE '%red%' AS has_red,
  starts_with(p_type, 'S') AS s_type FROM part""")
def fn_string(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.lower("p_brand").alias("brand"), item(name, " ", 1).alias("second_word"),
        count_char(name, "e").alias("n_e"), name.contains("red").alias("has_red"),
        F.col("p_type").startswith("S").alias("s_type"),
    )


@query("fn_packed_version", """
SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE (k % 9)::DOUBLE + (k % 13)::DOUBLE / 100.0::DOUBLE END AS version,
  CAST(k % 9 AS INTEGER) AS major FROM ev""", ["ev"])
def fn_version(spark, d):
    k = F.col("k")
    packed = F.when(k % 10 == 0, (k % 9).cast("string")).otherwise(F.concat_ws(".", k % 9, k % 13, F.lit("x")))
    return ev(spark, d).select("event_id", version_number(packed).alias("version"), to_int(item(packed, r"\.", 0)).alias("major"))


@query("fn_packed_device", """
SELECT event_id, k AS level, CASE WHEN k % 7 <> 6 THEN k % 7 END AS status, k + 300 AS width,
  CASE WHEN k % 7 = 0 THEN NULL ELSE (k % 8 + 1)::DOUBLE END AS total_gib, (k % 8 + 1)::DOUBLE / 2 AS memory_gib,
  strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS boot FROM ev""", ["ev"])
def fn_device(spark, d):
    k = F.col("k")
    size = (k % 8 + 1).cast("bigint") * 1073741824
    battery = F.concat(k.cast("string"), F.lit("%|"), F.when(k % 7 != 6, (k % 7).cast("string")).otherwise("?"))
    storage = F.when(k % 7 == 0, "a,b").otherwise(F.concat(F.lit("a,b,"), size.cast("string"), F.lit("B,5B")))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ev(spark, d).select(
        "event_id",
        battery_part(battery, 0).alias("level"),
        battery_part(battery, 1).alias("status"),
        screen_width(F.concat((k + 300).cast("string"), F.lit(",900"))).alias("width"),
        storage_gib(storage, 2).alias("total_gib"),
        bytes_to_gib((size / 2).cast("string")).alias("memory_gib"),
        F.date_format(boot_date(F.concat(F.lit("x|"), seconds.cast("string"))), "yyyy-MM-dd HH:mm:ss").alias("boot"),
    )


@query("fn_app_package", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'com.' || p_name WHEN 1 THEN p_name END AS app_id FROM part""")
def fn_app(spark, d):
    name = F.col("p_name")
    entry = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("App,-"), name)).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("App,"), name)
    ).otherwise(name)
    return table(spark, d, "part").select("p_partkey", app_package(entry).alias("app_id"))


@query("fn_json", """
SELECT event_id, k, CASE WHEN k > 50 THEN k END AS big FROM ev""", ["ev"])
def fn_json(spark, d):
    parsed = F.from_json("props", "k int")["k"]
    packed = F.to_json(F.struct(F.when(parsed > 50, parsed).alias("big")))
    return table(spark, d, "events").select(
        "event_id", parsed.alias("k"), F.get_json_object(packed, "$.big").cast("int").alias("big")
    )


@query("fn_math", """
SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 49 THEN round(ln((p_size / 50.0::DOUBLE) / (1.0::DOUBLE - p_size / 50.0::DOUBLE)), 9)
  END AS odds, greatest(p_size, CASE WHEN p_size % 2 = 0 THEN 25 END) AS hi,
  least(p_size, CASE WHEN p_size % 2 = 0 THEN 25 END) AS lo FROM part""")
def fn_math(spark, d):
    size = F.col("p_size")
    p = F.when(size.between(1, 49), size / 50.0)
    even = F.when(size % 2 == 0, 25)
    return table(spark, d, "part").select(
        "p_partkey", F.round(log_odds(p), 9).alias("odds"), F.greatest(size, even).alias("hi"), F.least(size, even).alias("lo")
    )


@query("fn_condition", """
SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band,
  coalesce(CASE WHEN k % 2 = 0 THEN k END, -1) AS even_or_minus FROM ev""", ["ev"])
def fn_condition(spark, d):
    value = F.col("value")
    return ev(spark, d).select(
        "event_id", ladder([(value > 100, "high"), (value > 10, "mid")], "low").alias("band"),
        F.coalesce(F.when(F.col("k") % 2 == 0, F.col("k")), F.lit(-1)).alias("even_or_minus"),
    )
