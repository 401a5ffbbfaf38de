"""Stand-ins for the production tables, derived by Spark from the given tables.

Each has a Spark form and a SQL form that yield the same rows. They carry nulls, ties, copies,
empty intervals and malformed values, because the given tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.plans.devices import DeviceLists
from workload.base import spread, table

LOAN_ANCHOR = "1998-06-30"
ACTION_ANCHOR = "2024-01-31"
JOB_DAY = "2024-01-28"
APP_ANCHOR, APP_TODAY = "2024-04-20", "2024-04-16"

LISTS = DeviceLists(
    app_names={"alpha": ["Alpha Bank", "alpha"], "beta": ["Beta Shop"]},
    networks={"network_is_wifi": ["wifi"], "network_is_mobile": ["lte", "5g"]},
    carriers={"carrier_globe": ["globe"], "carrier_smart": ["smart", "tnt"]},
    manufacturers={"manufacturer_samsung": "samsung", "manufacturer_xiaomi": "xiaomi"},
)
RISK_WORDS = ["the", "of", "de", "la", "der", "is", "that", "und", "com.there", "com.which", "com.nicht"]

TABLE_SQL: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}

# ---------------------------------------------------------------- loans

TABLE_SQL["loan_daily"] = """
SELECT CAST(o_custkey AS VARCHAR) AS client_no, CAST(l_orderkey AS VARCHAR) AS loan_no,
  CASE l_linenumber % 4 WHEN 0 THEN '101' WHEN 1 THEN '102' WHEN 2 THEN '120' ELSE '999' END AS prod_type,
  l_returnflag AS product_type, l_linenumber AS tenor,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_extendedprice END
    AS outstanding_principal,
  CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_extendedprice * l_tax END AS outstanding_interest,
  CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_discount END AS outstanding_fee,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL
       ELSE CAST(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) % 45 AS INTEGER) END AS day_past_due,
  CAST(o_totalprice AS DECIMAL(18,2)) AS loan_disb, o_orderdate::DATE AS loan_disbursement_date,
  strftime(l_shipdate, '%Y-%m-%d') AS pt_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def loan_daily(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.col("l_linenumber")
    returned = F.col("l_returnflag") == "R"
    prod = F.when(line % 4 == 0, "101").when(line % 4 == 1, "102").when(line % 4 == 2, "120").otherwise("999")
    ship, order = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    return rows.select(
        F.col("o_custkey").cast("string").alias("client_no"),
        F.col("l_orderkey").cast("string").alias("loan_no"),
        prod.alias("prod_type"),
        F.col("l_returnflag").alias("product_type"),
        line.alias("tenor"),
        F.when(line == 7, None).when(returned, 0.0).otherwise(F.col("l_extendedprice")).alias("outstanding_principal"),
        F.when(returned, 0.0).otherwise(F.col("l_extendedprice") * F.col("l_tax")).alias("outstanding_interest"),
        F.when(returned, 0.0).otherwise(F.col("l_discount")).alias("outstanding_fee"),
        F.when(line % 5 == 0, None).otherwise(F.abs(F.datediff(ship, order)) % 45).alias("day_past_due"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("loan_disb"),
        order.alias("loan_disbursement_date"),
        F.date_format(ship, "yyyy-MM-dd").alias("pt_date"),
    )


TABLE_SQL["accounts"] = """
SELECT client_no, tenor, CASE tenor WHEN 3 THEN NULL WHEN 5 THEN 'REFUND' ELSE 'NORMAL' END AS repayment_status,
  prod_type AS sub_prod_code, loan_disbursement_date AS disburse_date, day_past_due AS dpd,
  strftime(last_day(CAST(pt_date AS DATE)), '%Y-%m-%d') AS pt_date
FROM loan_daily
"""
NEEDS["accounts"] = ["loan_daily"]


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """Month-end snapshot of loan accounts."""
    status = F.when(F.col("tenor") == 3, None).when(F.col("tenor") == 5, "REFUND").otherwise("NORMAL")
    return loan_daily(spark, d).select(
        "client_no",
        "tenor",
        status.alias("repayment_status"),
        F.col("prod_type").alias("sub_prod_code"),
        F.col("loan_disbursement_date").alias("disburse_date"),
        F.col("day_past_due").alias("dpd"),
        F.date_format(F.last_day("pt_date"), "yyyy-MM-dd").alias("pt_date"),
    )


TABLE_SQL["applications"] = """
SELECT CAST(o_custkey AS VARCHAR) AS client_no, CAST(o_orderkey AS VARCHAR) AS loan_no,
  o_orderdate::DATE AS dc_start_date, (o_orderdate::DATE + CAST(o_orderkey % 60 AS INTEGER)) AS dc_end_date,
  (epoch_us(o_orderdate) // 1000) - (o_orderkey % 3) * 86400000 AS application_timestamp,
  CASE o_orderstatus WHEN 'F' THEN 'LOAN_FAIL' ELSE 'LOAN_OK' END AS status
FROM orders
"""


def applications(spark: SparkSession, d: str) -> DataFrame:
    """Application versions with validity intervals; some are empty."""
    start = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("client_no"),
        F.col("o_orderkey").cast("string").alias("loan_no"),
        start.alias("dc_start_date"),
        F.date_add(start, (F.col("o_orderkey") % 60).cast("int")).alias("dc_end_date"),
        (F.unix_millis(F.col("o_orderdate").cast("timestamp")) - (F.col("o_orderkey") % 3) * 86400000).alias(
            "application_timestamp"
        ),
        F.when(F.col("o_orderstatus") == "F", "LOAN_FAIL").otherwise("LOAN_OK").alias("status"),
    )


# ---------------------------------------------------------------- events

TABLE_SQL["ev"] = """
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
"""


def ev(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


TABLE_SQL["actions"] = """
SELECT CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 101 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END
    AS client_no,
  CASE WHEN event_id % 89 = 0 THEN '' ELSE CAST(user_id + k % 7 AS VARCHAR) END AS device_id,
  (epoch_us(ts) // 1000) AS action_timestamp,
  CASE event_type WHEN 'click' THEN 1001 WHEN 'view' THEN 1061 WHEN 'purchase' THEN 1156 WHEN 'error' THEN 1072
    ELSE 7 END AS scene_code,
  CASE WHEN event_type = 'error' THEN '0' ELSE '1' END AS action_status, strftime(ts, '%Y-%m-%d') AS pt_date
FROM ev
"""
NEEDS["actions"] = ["ev"]


def actions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    scene = (
        F.when(kind == "click", 1001).when(kind == "view", 1061).when(kind == "purchase", 1156)
        .when(kind == "error", 1072).otherwise(7)
    )
    client = (
        F.when(F.col("event_id") % 97 == 0, "").when(F.col("event_id") % 101 == 0, None)
        .otherwise(F.col("user_id").cast("string"))
    )
    device = F.when(F.col("event_id") % 89 == 0, "").otherwise((F.col("user_id") + F.col("k") % 7).cast("string"))
    return ev(spark, d).select(
        client.alias("client_no"),
        device.alias("device_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("action_timestamp"),
        scene.alias("scene_code"),
        F.when(kind == "error", "0").otherwise("1").alias("action_status"),
        F.date_format("ts", "yyyy-MM-dd").alias("pt_date"),
    )


# Distinct (client, device, days ago) of the successful actions, as the device features use them.
TABLE_SQL["used"] = f"""
SELECT DISTINCT client_no, device_id,
  CAST(date_diff('day', make_timestamp(action_timestamp * 1000)::DATE, DATE '{ACTION_ANCHOR}') AS INTEGER)
    AS days_from_operation
FROM actions
WHERE client_no <> '' AND device_id <> '' AND action_status = '1' AND scene_code IN (1001, 1061, 1072, 1156)
  AND date_diff('day', make_timestamp(action_timestamp * 1000)::DATE, DATE '{ACTION_ANCHOR}') BETWEEN 0 AND 29
"""
NEEDS["used"] = ["actions"]

TABLE_SQL["price"] = """
SELECT p_type AS model, CASE WHEN p_brand = 'Brand#1' THEN 'apple' ELSE lower(p_brand) END AS brand,
  DATE '2023-01-01' + CAST(p_partkey % 50 AS INTEGER) AS grass_date, p_retailprice AS price_usd_median
FROM part
"""


def price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_type").alias("model"),
        F.when(F.col("p_brand") == "Brand#1", "apple").otherwise(F.lower("p_brand")).alias("brand"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("p_partkey") % 50).cast("int")).alias("grass_date"),
        F.col("p_retailprice").alias("price_usd_median"),
    )


MODELS = ["ECONOMY", "STANDARD", "PROMO", "LARGE", "SMALL", "MEDIUM"]


def device_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw device records with values packed the way the log packs them; every tenth record comes twice."""
    k, user = F.col("k"), F.col("user_id")

    def text(c):
        return c.cast("string")

    def pick(mod: int, values: list[str | None], of=k):
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for i, v in enumerate(values):
            out = out.when(of % mod == i, F.lit(v).cast("string"))
        return out

    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    total, used = (k % 8 + 1).cast("bigint") * 1073741824, (k % 11).cast("bigint") * 900000000
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 10 == 0, 2).otherwise(1)))
    return spread(ev(spark, d)).withColumn("copy", copies).select(
        text(user).alias("device_id"),
        F.when(k % 10 == 9, "harmony").otherwise(pick(4, ["android", "android", "iOS", "iPadOS"])).alias("os"),
        F.concat(text(10 + k % 8), F.lit("."), text(k % 5)).alias("os_ver"),
        pick(6, MODELS, user).alias("model"),
        F.when(F.col("event_type") == "click", "Alpha Bank").when(F.col("event_type") == "view", "alpha")
        .when(F.col("event_type") == "purchase", "Beta Shop").when(k % 2 == 0, "Other").alias("app_name"),
        F.when(k % 4 < 2, pick(3, ["true", "false", None])).otherwise(pick(3, ["0|1|1", "0|1|0", None]))
        .alias("is_jailbreak"),
        F.concat(text(k % 9), F.lit("."), text(k % 13), F.lit(".7")).alias("android_app_ver"),
        pick(5, [None, "ABSENT", "ABSENT,READY", "LOADED", "UNKNOWN,ABSENT"]).alias("android_sim_card"),
        F.when(k % 6 == 0, "tun0").alias("android_vpn"),
        (millis - k.cast("bigint") * 7200000).alias("android_boot_time"),
        F.when(k % 7 == 0, "a,b").otherwise(F.concat(F.lit("a,b,"), text(total), F.lit("B,"), text(used), F.lit("B")))
        .alias("android_internal_storage"),
        pick(3, [None, "Globe,Smart", "DITO,TNT"]).alias("android_carrier"),
        pick(4, ["WIFI,LTE", None, "lte", "ethernet"], k % 16 + user).alias("android_network_type"),
        F.when(k == 50, "x").otherwise(text(k)).alias("android_battery_level"),
        text(k % 7).alias("android_battery_status"),
        F.concat(text(720 + k), F.lit(",1280")).alias("android_screen"),
        text(20 + k % 14).alias("android_os_ver_int"),
        F.concat(F.lit("BRAND#"), text(1 + user % 25)).alias("android_brand"),
        pick(3, ["Samsung", "XIAOMI", None], user).alias("android_manufacturer"),
        text(4 + k % 5).alias("android_cpu_count"),
        pick(3, ["false", "true", None]).alias("android_is_emulator"),
        F.concat(text(k % 9), F.lit("."), text(k % 13)).alias("ios_app_ver"),
        pick(3, ["1", "0", None]).alias("ios_is_sim_card"),
        pick(4, [None, None, "1", "0"]).alias("ios_is_vpn_connected"),
        F.concat(F.lit("x|"), text(F.floor(millis / 1000) - k * 3600)).alias("ios_resume_boot_time"),
        text(used).alias("ios_free_storage"),
        text(total).alias("ios_total_storage"),
        pick(3, ["GLOBE", "tnt", None]).alias("ios_carrier"),
        pick(3, ["WiFi", "5G", None], k + user).alias("ios_network_type"),
        F.concat(text(k), F.lit("%|"), text(k % 5)).alias("ios_battery"),
        F.concat(text(300 + k), F.lit(",800")).alias("ios_screen"),
        text(total / 2).alias("ios_memory"),
        F.col("ts").alias("collection_time"),
        F.date_format("ts", "yyyy-MM-dd").alias("pt_date"),
    )


# The normalised devices, written down from the plain values instead of decoding packed strings.
TABLE_SQL["device_norm"] = f"""
WITH v AS (
  SELECT *, k % 4 >= 2 AS ios, (k % 8 + 1)::DOUBLE AS total, ((k % 11)::BIGINT * 900000000) / 1073741824.0::DOUBLE AS used,
    CASE event_type WHEN 'click' THEN 'alpha' WHEN 'view' THEN 'alpha' WHEN 'purchase' THEN 'beta' END AS app
  FROM ev WHERE k % 10 <> 9)
SELECT CAST(user_id AS VARCHAR) AS device_id,
  CASE k % 4 WHEN 2 THEN 'iOS' WHEN 3 THEN 'iPadOS' ELSE 'android' END AS os,
  CASE user_id % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'PROMO' WHEN 3 THEN 'LARGE'
    WHEN 4 THEN 'SMALL' ELSE 'MEDIUM' END AS model,
  app AS app_name, ts AS collection_time,
  CASE WHEN ios THEN -999997 ELSE 20 + k % 14 END AS android_os_ver,
  CASE WHEN ios THEN 10 + k % 8 ELSE -999997 END AS ios_os_ver,
  CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS is_jailbreak,
  CASE WHEN ios THEN CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END
       ELSE CASE WHEN k % 5 IN (2, 3) THEN 1 ELSE 0 END END AS is_sim_card,
  CASE WHEN ios THEN CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END
       ELSE CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END END AS is_vpn_connected,
  CAST(date_diff('day', CASE WHEN ios THEN make_timestamp(((epoch_us(ts) // 1000) // 1000 - k * 3600) * 1000000)
    ELSE make_timestamp(((epoch_us(ts) // 1000) - k * 7200000) * 1000) END::DATE, DATE '{ACTION_ANCHOR}') AS INTEGER)
    AS days_from_boot,
  CASE WHEN NOT ios AND k % 7 = 0 THEN NULL ELSE total END AS total_storage,
  CASE WHEN used > total OR (NOT ios AND k % 7 = 0) THEN NULL WHEN ios THEN (total * 1073741824.0::DOUBLE
    - (k % 11)::BIGINT * 900000000) / 1073741824.0::DOUBLE ELSE used END AS used_storage,
  CASE WHEN NOT ios AND k = 50 THEN NULL ELSE k END AS battery_level,
  CASE WHEN ios THEN CASE k % 5 WHEN 1 THEN 'not_charging' WHEN 2 THEN 'charging' WHEN 3 THEN 'fully_charged' END
       ELSE CASE k % 7 WHEN 2 THEN 'charging' WHEN 3 THEN 'not_charging' WHEN 4 THEN 'not_charging'
                       WHEN 5 THEN 'fully_charged' END END AS battery_status,
  CASE WHEN ios THEN 300 + k ELSE 720 + k END AS screen_width,
  CASE WHEN ios THEN 'apple' ELSE 'brand#' || (1 + user_id % 25) END AS brand,
  CASE WHEN ios THEN -999997 ELSE 4 + k % 5 END AS android_cpu_count,
  CASE WHEN ios THEN -999997 ELSE CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END END AS android_is_emulator,
  CASE WHEN ios THEN total / 2 ELSE -999997::DOUBLE END AS ios_memory,
  CASE WHEN ios THEN CASE (k + user_id) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END
       ELSE CASE (k % 16 + user_id) % 4 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END END AS network_is_wifi,
  CASE WHEN ios THEN CASE (k + user_id) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END
       ELSE CASE (k % 16 + user_id) % 4 WHEN 0 THEN 1 WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE 0 END END AS network_is_mobile,
  CASE WHEN ios THEN CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END END
    AS carrier_globe,
  CASE WHEN ios THEN CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END ELSE CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END END
    AS carrier_smart,
  CASE WHEN ios THEN -999997 WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS manufacturer_samsung,
  CASE WHEN ios THEN -999997 WHEN user_id % 3 = 1 THEN 1 ELSE 0 END AS manufacturer_xiaomi,
  CASE WHEN app = 'alpha' THEN (k % 9)::DOUBLE + (k % 13)::DOUBLE / 100.0::DOUBLE END AS alpha_app_ver,
  CASE WHEN app = 'beta' THEN (k % 9)::DOUBLE + (k % 13)::DOUBLE / 100.0::DOUBLE END AS beta_app_ver
FROM v
"""
NEEDS["device_norm"] = ["ev"]

# ---------------------------------------------------------------- app log

_ENTRY = """CASE WHEN length(w) = 1 THEN w WHEN length(w) = 5 THEN 'n,-' || w ELSE 'n,' || w END"""

TABLE_SQL["app_lists"] = f"""
SELECT source || '-' || lang AS device_id, strftime(DATE '2024-03-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS pt_date,
  doc_id % 13 = 0 AS broken, doc_id % 11 = 0 AS no_os, doc_id % 9 = 0 AS other_kind,
  CASE WHEN doc_id % 17 = 0 THEN [] ELSE list_transform(string_split(text, ' '), lambda w: {_ENTRY}) END AS apps
FROM documents
"""

TABLE_SQL["app_all"] = """
SELECT device_id, pt_date, CASE WHEN starts_with(p, '-') THEN 'com.' || substr(p, 2) ELSE p END AS app_id
FROM (SELECT device_id, pt_date, string_split(entry, ',')[2] AS p
      FROM (SELECT device_id, pt_date, unnest(apps) AS entry FROM app_lists
            WHERE NOT broken AND NOT no_os AND NOT other_kind))
"""
NEEDS["app_all"] = ["app_lists"]


def app_log(spark: SparkSession, d: str) -> DataFrame:
    """Device message log: JSON with a list of apps; some messages are broken or of another kind."""
    doc = F.col("doc_id")
    apps = F.transform(
        F.split("text", " "),
        lambda w: F.when(F.length(w) == 1, w).when(F.length(w) == 5, F.concat(F.lit("n,-"), w))
        .otherwise(F.concat(F.lit("n,"), w)),
    )
    apps = F.when(doc % 17 == 0, F.array().cast("array<string>")).otherwise(apps)
    message = F.to_json(
        F.struct(
            F.concat_ws("-", "source", "lang").alias("deviceId"),
            F.struct(F.when(doc % 11 != 0, "android").alias("os"), apps.alias("apps")).alias("deviceInfo"),
        )
    )
    day = F.date_add(F.lit("2024-03-01").cast("date"), (doc % 60).cast("int"))
    return spread(table(spark, d, "documents")).select(
        F.when(doc % 13 == 0, F.lit('{"deviceId": "x", broken')).otherwise(message).alias("message"),
        F.when(doc % 9 == 0, "other").otherwise("device-security").alias("pt_biz"),
        F.date_format(day, "yyyy-MM-dd").alias("pt_date"),
    )


# ---------------------------------------------------------------- job runs

TABLE_SQL["job_run"] = """
SELECT strftime(ts, '%Y-%m-%d') AS pt_date, 'job_' || (event_id // 2) AS job_id, 'u' || user_id AS user_id,
  CASE WHEN user_id % 8 <> 0 THEN 'name' || user_id END AS user_name, 't' || (user_id % 5) AS team_id,
  'team' || (user_id % 5) AS team_name,
  CASE event_type WHEN 'click' THEN 'Spark_etl' WHEN 'view' THEN 'daily_hive_load' WHEN 'purchase' THEN 'flink_sync'
    ELSE 'misc' END AS app_name,
  CASE WHEN user_id % 20 <> 19 THEN 'tbl_' || (user_id % 20) END AS task_table_name,
  CASE k % 4 WHEN 0 THEN 'root.p0' WHEN 1 THEN 'root.P1.high' WHEN 2 THEN 'adhoc' END AS app_queue,
  CASE k % 5 WHEN 0 THEN 'SPARK' WHEN 1 THEN 'MAPREDUCE' WHEN 2 THEN 'datax' WHEN 4 THEN 'hive' END AS app_type,
  CASE WHEN k = 7 THEN NULL WHEN event_type = 'error' AND k % 2 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS final_state,
  CASE WHEN k % 10 <> 9 THEN k % 6 END AS attempt_number, (k // 3) % 6 AS airflow_try_number,
  CASE WHEN k % 11 <> 0 THEN k::DOUBLE / 10.0::DOUBLE END AS avg_memory_allocate_gb,
  CASE WHEN k % 13 <> 0 THEN value / 2.0::DOUBLE END AS input_size_gb,
  value AS gb_max_shuffle_read_size,
  CASE WHEN k % 9 = 0 THEN 0.0::DOUBLE ELSE value / (1 + (k // 5) % 4)::DOUBLE END AS gb_avg_shuffle_read_size,
  value AS gb_max_shuffle_write_size,
  CASE WHEN k % 9 <> 1 THEN value / (1 + k % 4)::DOUBLE END AS gb_avg_shuffle_write_size,
  k::DOUBLE / 40.0::DOUBLE AS major_gc_time, CASE WHEN k % 8 = 0 THEN 0.0::DOUBLE ELSE value * 3.0::DOUBLE END AS task_time,
  CASE k % 3 WHEN 0 THEN value / 100.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS spill_disk_gb,
  CASE WHEN k % 12 <> 0 THEN value END AS elapsed_time_min, k::DOUBLE / 5.0::DOUBLE AS queue_wait_time,
  CASE WHEN k % 17 <> 0 THEN value * k::DOUBLE END AS memory_gb_hour,
  CASE WHEN event_id % 40 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS started_date
FROM ev
"""
NEEDS["job_run"] = ["ev"]


def job_run(spark: SparkSession, d: str) -> DataFrame:
    k, value, user = F.col("k"), F.col("value"), F.col("user_id")
    kind = F.col("event_type")
    as_double = k.cast("double")
    return ev(spark, d).select(
        F.date_format("ts", "yyyy-MM-dd").alias("pt_date"),
        F.concat(F.lit("job_"), F.floor(F.col("event_id") / 2).cast("string")).alias("job_id"),
        F.concat(F.lit("u"), user.cast("string")).alias("user_id"),
        F.when(user % 8 != 0, F.concat(F.lit("name"), user.cast("string"))).alias("user_name"),
        F.concat(F.lit("t"), (user % 5).cast("string")).alias("team_id"),
        F.concat(F.lit("team"), (user % 5).cast("string")).alias("team_name"),
        F.when(kind == "click", "Spark_etl").when(kind == "view", "daily_hive_load").when(kind == "purchase", "flink_sync")
        .otherwise("misc").alias("app_name"),
        F.when(user % 20 != 19, F.concat(F.lit("tbl_"), (user % 20).cast("string"))).alias("task_table_name"),
        F.when(k % 4 == 0, "root.p0").when(k % 4 == 1, "root.P1.high").when(k % 4 == 2, "adhoc").alias("app_queue"),
        F.when(k % 5 == 0, "SPARK").when(k % 5 == 1, "MAPREDUCE").when(k % 5 == 2, "datax").when(k % 5 == 4, "hive")
        .alias("app_type"),
        F.when(k == 7, None).when((kind == "error") & (k % 2 == 0), "FAILED").otherwise("FINISHED").alias("final_state"),
        F.when(k % 10 != 9, k % 6).alias("attempt_number"),
        (F.floor(k / 3) % 6).cast("int").alias("airflow_try_number"),
        F.when(k % 11 != 0, as_double / 10.0).alias("avg_memory_allocate_gb"),
        F.when(k % 13 != 0, value / 2.0).alias("input_size_gb"),
        value.alias("gb_max_shuffle_read_size"),
        F.when(k % 9 == 0, 0.0).otherwise(value / (1 + F.floor(k / 5) % 4)).alias("gb_avg_shuffle_read_size"),
        value.alias("gb_max_shuffle_write_size"),
        F.when(k % 9 != 1, value / (1 + k % 4)).alias("gb_avg_shuffle_write_size"),
        (as_double / 40.0).alias("major_gc_time"),
        F.when(k % 8 == 0, 0.0).otherwise(value * 3.0).alias("task_time"),
        F.when(k % 3 == 0, value / 100.0).when(k % 3 == 1, 0.0).alias("spill_disk_gb"),
        F.when(k % 12 != 0, value).alias("elapsed_time_min"),
        (as_double / 5.0).alias("queue_wait_time"),
        F.when(k % 17 != 0, value * as_double).alias("memory_gb_hour"),
        F.when(F.col("event_id") % 40 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
        .alias("started_date"),
    )


TABLE_SQL["job_copies"] = """
SELECT * EXCLUDE (c) REPLACE (job_id || '_' || c AS job_id, task_table_name || '_' || c AS task_table_name,
  elapsed_time_min * (1 + c * c)::DOUBLE AS elapsed_time_min, memory_gb_hour * (1 + c * c)::DOUBLE AS memory_gb_hour)
FROM job_run, (SELECT CAST(unnest(range(8)) AS INTEGER) AS c)
"""
NEEDS["job_copies"] = ["job_run"]


def job_copies(spark: SparkSession, d: str) -> DataFrame:
    """Eight jobs per job, the later ones larger: enough names and jobs a day for the first 100 to be a choice."""
    c = F.col("c")
    copies = job_run(spark, d).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    grown = {m: F.col(m) * (1 + c * c).cast("double") for m in ("elapsed_time_min", "memory_gb_hour")}
    named = {n: F.concat(F.col(n), F.lit("_"), c.cast("string")) for n in ("job_id", "task_table_name")}
    return copies.withColumns({**grown, **named}).drop("c")


# ---------------------------------------------------------------- score input

TABLE_SQL["score_input"] = """
SELECT CAST(c_custkey AS VARCHAR) AS client_no, c_mktsegment AS seg_obs,
  CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS ft_balance, coalesce(n, 0) AS ft_orders
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
"""


def score_input(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(counts, "c_custkey", "left").select(
        F.col("c_custkey").cast("string").alias("client_no"),
        F.col("c_mktsegment").alias("seg_obs"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("ft_balance"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("ft_orders"),
    )
