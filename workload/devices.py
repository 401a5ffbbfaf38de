"""PL9-PL11 queries."""

from pyspark.sql import functions as F

from creditloom.plans.apps import app_features, app_features_stepwise, parse_messages, app_entries, scan_messages
from creditloom.plans.devices import device_features, normalise_devices, raw_devices
from workload.base import query
from workload.standins import (
    ACTION_ANCHOR,
    APP_ANCHOR,
    APP_TODAY,
    LISTS,
    RISK_WORDS,
    actions,
    app_log,
    device_raw,
    price,
    score_input,
)

WINDOWS = (7, 14, 21, 30)
_DEVICE_COLUMNS = [
    "android_os_ver", "ios_os_ver", "is_jailbreak", "is_sim_card", "is_vpn_connected", "days_from_boot", "screen_width",
    "android_cpu_count", "android_is_emulator", "ios_memory", "network_is_wifi", "network_is_mobile", "carrier_globe",
    "carrier_smart", "manufacturer_samsung", "manufacturer_xiaomi", "alpha_app_ver", "beta_app_ver",
]
_COUNTED = [
    "device_id", "os", "model", "app_name", "collection_time", "total_storage", "used_storage", "battery_level",
    "battery_status", "brand", *_DEVICE_COLUMNS,
]
_NULLS = " + ".join(f"({c} IS NULL)::INTEGER" for c in _COUNTED)

# One row per device: last record, averages and price; records of the 30 partitions up to the anchor.
_TABLE = f"""
n AS (SELECT * FROM device_norm WHERE collection_time::DATE >= DATE '2024-01-02'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY collection_time::DATE DESC,
  {_NULLS}, collection_time DESC) AS r FROM n) WHERE r = 1),
p AS (SELECT device_id, sum_used / n_used AS avg_used_storage, sum_total / n_total AS avg_total_storage, avg_ratio
    AS avg_used_storage_ratio, b90 AS battery_level_ge_90_ratio, chg AS battery_charging_ratio, wifi AS network_wifi_ratio,
    ta AS trigger_app_alpha_ratio, tb AS trigger_app_beta_ratio FROM (
  SELECT device_id, sum(used_storage) AS sum_used, count(used_storage) AS n_used, sum(total_storage) AS sum_total,
    count(total_storage) AS n_total, avg(used_storage / total_storage) AS avg_ratio,
    count(*) FILTER (battery_level >= 90)::DOUBLE / nullif(count(battery_level), 0) AS b90,
    count(*) FILTER (battery_status IN ('charging', 'fully_charged'))::DOUBLE / nullif(count(battery_status), 0) AS chg,
    count(*) FILTER (network_is_wifi = 1)::DOUBLE / nullif(count(network_is_wifi), 0) AS wifi,
    count(*) FILTER (app_name = 'alpha')::DOUBLE / nullif(count(app_name), 0) AS ta,
    count(*) FILTER (app_name = 'beta')::DOUBLE / nullif(count(app_name), 0) AS tb FROM n GROUP BY device_id)),
lp AS (SELECT model, brand, price_usd_median AS last_price_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY model, brand ORDER BY grass_date DESC, price_usd_median) AS r FROM price)
  WHERE r = 1),
t AS (SELECT l.*, CAST(date_diff('day', collection_time::DATE, DATE '{ACTION_ANCHOR}') AS INTEGER) AS days_from_collection,
    p.* EXCLUDE (device_id), last_price_usd
  FROM l LEFT JOIN p USING (device_id) LEFT JOIN lp USING (model, brand))"""

_PERIOD = [
    "avg_used_storage", "avg_total_storage", "avg_used_storage_ratio", "battery_level_ge_90_ratio", "battery_charging_ratio",
    "network_wifi_ratio", "trigger_app_alpha_ratio", "trigger_app_beta_ratio",
]


def _number(col):
    return f"round(coalesce({col}, -999999), 6)" if col in _PERIOD + ["last_price_usd", "ios_memory"] else f"coalesce({col}, -999999)"


def _device_sql(prefix):
    cols = ["coalesce(os, 'NULL') AS device_last_os"]
    cols += [f"{_number(c)} AS device_last_{c}" for c in [*_DEVICE_COLUMNS, "days_from_collection"]]
    cols += [f"{_number(c)} AS device_{prefix}{c}" for c in _PERIOD]
    cols += [f"{_number('last_price_usd')} AS device_last_price_usd"]
    return ", ".join(cols)


def rounded(df, prefix):
    names = [f"device_{prefix}{c}" for c in _PERIOD] + ["device_last_price_usd", "device_last_ios_memory"]
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("pl9_normalise_devices", """
SELECT * REPLACE (round(used_storage, 6) AS used_storage, round(ios_memory, 6) AS ios_memory,
  strftime(collection_time, '%Y-%m-%d %H:%M:%S') AS collection_time) FROM device_norm
WHERE collection_time::DATE >= DATE '2024-01-02'""", ["device_norm"])
def pl9(spark, d):
    out = normalise_devices(raw_devices(device_raw(spark, d), ACTION_ANCHOR, 30), ACTION_ANCHOR, LISTS)
    return out.withColumns({
        "used_storage": F.round("used_storage", 6), "ios_memory": F.round("ios_memory", 6),
        "collection_time": F.date_format("collection_time", "yyyy-MM-dd HH:mm:ss"),
    })


@query("pl10_device_features", f"WITH {_TABLE} SELECT device_id, {_device_sql('')} FROM t", ["device_norm", "price"])
def pl10(spark, d):
    out = device_features(device_raw(spark, d), price(spark, d), ACTION_ANCHOR, LISTS, windows=WINDOWS)
    return rounded(out, "")


_WINDOW_SQL = ", ".join(
    f"count(DISTINCT device_id) FILTER (days_from_operation < {w}) AS d{w}, count(*) FILTER (days_from_operation < {w}) AS n{w}"
    for w in WINDOWS
)
_WINDOW_OUT = ", ".join(
    f"d{w} AS device_distinct_device_cnt_{w}d, CASE WHEN n{w} = 0 THEN -999998::DOUBLE ELSE d{w}::DOUBLE / n{w} END"
    f" AS device_distinct_device_cnt_norm_{w}d"
    for w in WINDOWS
)


@query("pl10_device_features_by_client", f"""WITH {_TABLE},
u AS (SELECT client_no, max(days_from_operation) - min(days_from_operation) AS span,
  min(days_from_operation) AS last_age, {_WINDOW_SQL} FROM used GROUP BY client_no),
la AS (SELECT client_no, device_id FROM (SELECT *, row_number() OVER (PARTITION BY client_no
  ORDER BY days_from_operation, device_id) AS r FROM used) WHERE r = 1),
c AS (SELECT u.client_no, span AS device_operation_duration_30d, last_age AS device_last_days_from_operation, {_WINDOW_OUT},
    {_device_sql('last_')} FROM u LEFT JOIN la USING (client_no) LEFT JOIN t USING (device_id))
SELECT s.client_no, c.* EXCLUDE (client_no) FROM score_input s LEFT JOIN c ON c.client_no = s.client_no""",
       ["device_norm", "price", "used", "score_input"])
def pl10_client(spark, d):
    out = device_features(
        device_raw(spark, d), price(spark, d), ACTION_ANCHOR, LISTS, "client_no", actions(spark, d),
        score_input(spark, d), WINDOWS, "pt_date",
    )
    return rounded(out, "last_")


_RISK = ", ".join(f"'{w}'" for w in RISK_WORDS)
_APPS = f"""
a AS (SELECT DISTINCT device_id, app_id, pt_date, CASE WHEN app_id IN ({_RISK}) THEN 1 ELSE 0 END AS risk
  FROM app_all WHERE pt_date BETWEEN '2024-03-07' AND '2024-04-15'),
lt AS (SELECT device_id, max(pt_date) AS latest FROM a GROUP BY 1),
f1 AS (SELECT device_id, CAST(sum(risk) AS BIGINT) AS app_latest_lending_cnt FROM (
  SELECT DISTINCT a.device_id, app_id, risk FROM a JOIN lt ON lt.device_id = a.device_id AND pt_date = latest) GROUP BY 1),
f2 AS (SELECT device_id, CAST(sum(risk) AS BIGINT) AS n FROM (
  SELECT DISTINCT device_id, app_id, risk FROM a WHERE pt_date >= '2024-03-26') GROUP BY 1)
SELECT device_id, app_latest_lending_cnt, coalesce(n, 0) AS app_historical_lending_cnt FROM f1 LEFT JOIN f2 USING (device_id)"""


@query("pl11_app_features", f"WITH {_APPS}", ["app_all"])
def pl11(spark, d):
    return app_features(app_log(spark, d), APP_ANCHOR, APP_TODAY, RISK_WORDS, history_days=20)


@query("pl11_app_features_stepwise", f"WITH {_APPS}", ["app_all"])
def pl11_stepwise(spark, d):
    rows = app_entries(parse_messages(scan_messages(app_log(spark, d), APP_ANCHOR, APP_TODAY)))
    return app_features_stepwise(rows, RISK_WORDS, "2024-03-26")


