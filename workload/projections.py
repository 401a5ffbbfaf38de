"""PF*, UN* queries."""

from pyspark.sql import functions as F

from creditloom.functions.columns import (
    classify,
    clamp_start,
    keep_if_le,
    map_codes,
    member_flag,
    null_count,
    null_where,
)
from creditloom.functions.dates import clamp_anchor, from_epoch_ms
from creditloom.operators.projections import (
    add_prefix,
    add_suffix,
    align_columns,
    days_ago_window,
    fill_sentinels,
    membership_flags,
    require_keys,
    select_ordered,
    sum_columns,
    threshold_flags,
    union_aligned,
    union_all,
    with_constants,
)
from creditloom.plans.loans import DPD_CLASSES
from workload.base import query
from workload.standins import ACTION_ANCHOR, actions, applications, ev, job_run, loan_daily, score_input


@query("pf1_sum_columns", """
SELECT client_no, loan_no, pt_date, tenor, outstanding_principal + outstanding_interest + outstanding_fee AS cur_balance
FROM loan_daily""", ["loan_daily"])
def pf1(spark, d):
    parts = ["outstanding_principal", "outstanding_interest", "outstanding_fee"]
    return sum_columns(loan_daily(spark, d), parts, "cur_balance").select(
        "client_no", "loan_no", "pt_date", "tenor", "cur_balance"
    )


@query("pf2_threshold_flags", """
SELECT client_no, loan_no, pt_date, day_past_due, 1 AS label_0dpd,
  CASE WHEN day_past_due >= 1 THEN 1 ELSE 0 END AS label_xdpd,
  CASE WHEN day_past_due >= 8 THEN 1 ELSE 0 END AS label_7dpd,
  CASE WHEN day_past_due >= 16 THEN 1 ELSE 0 END AS label_15dpd,
  CASE WHEN day_past_due >= 31 THEN 1 ELSE 0 END AS label_30dpd
FROM loan_daily""", ["loan_daily"])
def pf2(spark, d):
    rows = loan_daily(spark, d).select("client_no", "loan_no", "pt_date", "day_past_due")
    minimums = {f"label_{c}": low for c, low in DPD_CLASSES.items()}
    return threshold_flags(rows, "day_past_due", minimums, ["label_0dpd"])


@query("pf3_predicates", """
SELECT client_no, loan_no, prod_type, pt_date FROM loan_daily
WHERE prod_type IN ('101', '102', '120') AND product_type <> 'R' AND pt_date >= '1997-01-01'""", ["loan_daily"])
def pf3(spark, d):
    return loan_daily(spark, d).where(
        F.col("prod_type").isin("101", "102", "120") & (F.col("product_type") != "R") & (F.col("pt_date") >= "1997-01-01")
    ).select("client_no", "loan_no", "prod_type", "pt_date")


@query("pf4_require_keys", """
SELECT client_no, device_id, action_timestamp FROM actions
WHERE client_no IS NOT NULL AND client_no <> '' AND device_id IS NOT NULL AND device_id <> ''""", ["actions"])
def pf4(spark, d):
    return require_keys(actions(spark, d), ["client_no", "device_id"]).select(
        "client_no", "device_id", "action_timestamp"
    )


@query("pf5_days_ago_window", f"""
SELECT client_no, device_id, action_timestamp, CAST(a AS INTEGER) AS days_ago
FROM (SELECT *, date_diff('day', make_timestamp(action_timestamp * 1000)::DATE, DATE '{ACTION_ANCHOR}') AS a FROM actions)
WHERE a >= 0 AND a < 14""", ["actions"])
def pf5(spark, d):
    rows = days_ago_window(
        actions(spark, d), from_epoch_ms(F.col("action_timestamp")), ACTION_ANCHOR, 14, part="pt_date"
    )
    return rows.select("client_no", "device_id", "action_timestamp", "days_ago")


@query("pf6_clamp_anchor", """
SELECT loan_no, pt_date FROM loan_daily WHERE pt_date >= '1998-03-07' AND pt_date <= '1998-06-14'""", ["loan_daily"])
def pf6(spark, d):
    first, last = clamp_anchor("1998-06-30", "1998-06-15", 360, "1998-03-07")
    return loan_daily(spark, d).where(F.col("pt_date").between(first, last)).select("loan_no", "pt_date")


@query("pf7_classify", """
SELECT job_id, pt_date, CASE
  WHEN regexp_matches(lower(coalesce(app_type, '') || '/' || coalesce(app_name, '')), 'spark') THEN 'Spark'
  WHEN regexp_matches(lower(coalesce(app_type, '') || '/' || coalesce(app_name, '')), 'hive') THEN 'Hive'
  WHEN regexp_matches(lower(coalesce(app_type, '') || '/' || coalesce(app_name, '')), 'flink') THEN 'Flink'
  WHEN regexp_matches(lower(coalesce(app_type, '') || '/' || coalesce(app_name, '')), 'datax') THEN 'DataX'
  ELSE 'Other' END AS task_type_label FROM job_run""", ["job_run"])
def pf7(spark, d):
    rules = [("Spark", ["spark"]), ("Hive", ["hive"]), ("Flink", ["flink"]), ("DataX", ["datax"])]
    label = classify([F.col("app_type"), F.col("app_name")], rules, "Other")
    return job_run(spark, d).select("job_id", "pt_date", label.alias("task_type_label"))


@query("pf8_map_codes", """
SELECT event_id, CASE k % 5 WHEN 1 THEN 'not_charging' WHEN 2 THEN 'charging' WHEN 3 THEN 'fully_charged' END
  AS battery_status, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 0 ELSE -1 END AS code FROM ev""", ["ev"])
def pf8(spark, d):
    words = {1: "not_charging", 2: "charging", 3: "fully_charged"}
    return ev(spark, d).select(
        "event_id",
        map_codes(F.col("k") % 5, words).alias("battery_status"),
        map_codes(F.col("event_type"), {"click": 1, "error": 0}, -1).alias("code"),
    )


@query("pf9_membership_flags", """
SELECT event_id, CASE WHEN k % 4 = 3 THEN NULL WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS is_read,
  CASE WHEN k % 4 = 3 THEN NULL WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error,
  CASE WHEN k % 4 <> 3 AND event_type IN ('click', 'view') THEN 1 ELSE 0 END AS read_or_zero FROM ev""", ["ev"])
def pf9(spark, d):
    rows = ev(spark, d).select("event_id", F.when(F.col("k") % 4 != 3, F.col("event_type")).alias("kind"))
    flags = membership_flags(rows, "kind", {"is_read": ["click", "view"], "is_error": ["error"]}, "keep")
    return flags.withColumn("read_or_zero", member_flag(F.col("kind"), ["click", "view"])).drop("kind")


@query("pf10_add_prefix", """
SELECT client_no, ft_balance AS device_ft_balance, ft_orders AS device_ft_orders, seg_obs AS device_seg_obs
FROM score_input""", ["score_input"])
def pf10(spark, d):
    return add_prefix(score_input(spark, d), "device", ["client_no"])


@query("pf11_add_suffix", """
SELECT client_no, seg_obs, ft_balance AS ft_balance_woe, ft_orders AS ft_orders_woe FROM score_input""", ["score_input"])
def pf11(spark, d):
    return add_suffix(score_input(spark, d), "ft_", "_woe")


_HALVES = """
a AS (SELECT event_id, value, k AS android_cores FROM ev WHERE event_type = 'click'),
b AS (SELECT event_id, value, 'apple' AS brand, user_id AS ios_memory FROM ev WHERE event_type IS DISTINCT FROM 'click')"""


def halves(spark, d):
    rows = ev(spark, d)
    a = rows.where(F.col("event_type") == "click").select("event_id", "value", F.col("k").alias("android_cores"))
    b = rows.where(~F.col("event_type").eqNullSafe("click")).select(
        "event_id", "value", F.lit("apple").alias("brand"), F.col("user_id").alias("ios_memory")
    )
    return a, b


@query("pf12_align_columns", f"""WITH {_HALVES}
SELECT 'first' AS side, event_id, value, 'other' AS brand, CAST(-999997 AS BIGINT) AS ios_memory, android_cores FROM a
UNION ALL SELECT 'second', event_id, value, brand, ios_memory, -999997 FROM b""", ["ev"])
def pf12(spark, d):
    first, second = align_columns(*halves(spark, d), -999997, {"brand": "other"})
    return first.withColumn("side", F.lit("first")).unionByName(second.withColumn("side", F.lit("second")))


@query("un1_union_aligned", f"""WITH {_HALVES}
SELECT event_id, value, 'other' AS brand, CAST(-999997 AS BIGINT) AS ios_memory, android_cores FROM a
UNION ALL SELECT event_id, value, brand, ios_memory, -999997 FROM b""", ["ev"])
def un1(spark, d):
    a, b = halves(spark, d)
    return union_aligned(a, b, -999997, {"brand": "other"})


@query("un2_union_all", """
SELECT client_no, pt_date, count(*) AS n FROM accounts WHERE pt_date IN ('1998-04-30', '1998-05-31', '1998-06-30')
GROUP BY ALL""", ["accounts"])
def un2(spark, d):
    rows = loan_daily(spark, d).select("client_no", F.date_format(F.last_day("pt_date"), "yyyy-MM-dd").alias("pt_date"))
    per_date = [
        rows.where(F.col("pt_date") == day).groupBy("client_no", "pt_date").agg(F.count(F.lit(1)).alias("n"))
        for day in ("1998-04-30", "1998-05-31", "1998-06-30")
    ]
    return union_all(per_date)


@query("pf13_fill_sentinels", """
SELECT job_id, coalesce(user_name, 'NULL') AS user_name, coalesce(attempt_number, -999999) AS attempt_number,
  coalesce(memory_gb_hour, -999999) AS memory_gb_hour, app_type FROM job_run""", ["job_run"])
def pf13(spark, d):
    rows = job_run(spark, d).select("job_id", "user_name", "attempt_number", "memory_gb_hour", "app_type")
    return fill_sentinels(rows, cols=["user_name", "attempt_number", "memory_gb_hour"])


@query("pf14_select_ordered", "SELECT ft_orders, client_no, ft_balance FROM score_input", ["score_input"])
def pf14(spark, d):
    return select_ordered(score_input(spark, d), ["ft_orders", "client_no", "ft_balance"])


@query("pf15_null_where", """
SELECT client_no, CASE WHEN seg_obs <> 'BUILDING' THEN ft_balance END AS ft_balance FROM score_input""", ["score_input"])
def pf15(spark, d):
    return score_input(spark, d).select(
        "client_no", null_where(F.col("seg_obs") == "BUILDING", F.col("ft_balance")).alias("ft_balance")
    )


@query("pf16_clamp_start", """
SELECT loan_no, strftime(greatest(dc_start_date, DATE '1998-02-20'), '%Y-%m-%d') AS start_date FROM applications""",
       ["applications"])
def pf16(spark, d):
    start = clamp_start(F.col("dc_start_date"), F.lit("1998-02-20").cast("date"))
    return applications(spark, d).select("loan_no", F.date_format(start, "yyyy-MM-dd").alias("start_date"))


@query("pf17_keep_if_le", """
SELECT job_id, pt_date, CASE WHEN avg_memory_allocate_gb <= input_size_gb THEN avg_memory_allocate_gb END AS used
FROM job_run""", ["job_run"])
def pf17(spark, d):
    used = keep_if_le(F.col("avg_memory_allocate_gb"), F.col("input_size_gb"))
    return job_run(spark, d).select("job_id", "pt_date", used.alias("used"))


@query("pf18_null_count", """
SELECT job_id, pt_date, (CASE WHEN user_name IS NULL THEN 1 ELSE 0 END) + (CASE WHEN app_queue IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN memory_gb_hour IS NULL THEN 1 ELSE 0 END) AS num_nulls FROM job_run""", ["job_run"])
def pf18(spark, d):
    cols = [F.col(c) for c in ("user_name", "app_queue", "memory_gb_hour")]
    return job_run(spark, d).select("job_id", "pt_date", null_count(cols).alias("num_nulls"))


@query("pf19_with_constants", """
SELECT client_no, ft_orders, '1998-06-30' AS pt_date, 5 AS run FROM score_input""", ["score_input"])
def pf19(spark, d):
    rows = score_input(spark, d).select("client_no", "ft_orders")
    return with_constants(rows, {"pt_date": "1998-06-30", "run": 5})


