"""J* queries."""

from pyspark.sql import functions as F

from creditloom.functions.columns import any_in_list
from creditloom.functions.dates import month_ends
from creditloom.operators.aggregates import activity_span, group_count, month_rollup
from creditloom.operators.joins import (
    attach,
    attach_labels,
    attach_last_entity,
    attach_month_value,
    expand_validity,
    lookup,
    onto_population,
    tag_in_list,
    with_group_value,
)
from creditloom.operators.windows import as_of_join, last_entity, latest_as_of, valid_counts
from creditloom.plans.apps import app_entries, parse_messages
from creditloom.plans.devices import latest_price
from creditloom.plans.loans import application_days, client_months
from workload.aggregates import used
from workload.base import query, table
from workload.standins import (
    LOAN_ANCHOR,
    RISK_WORDS,
    accounts,
    app_log,
    applications,
    ev,
    job_run,
    loan_daily,
    price,
    score_input,
)

MONTHS = month_ends(LOAN_ANCHOR)


@query("j1_blocks_from_one_rollup", """WITH
m AS (SELECT client_no, loan_no, last_day(CAST(pt_date AS DATE)) AS m, max(day_past_due) AS dpd FROM loan_daily GROUP BY ALL),
ever AS (SELECT client_no, max(CASE WHEN m = DATE '1998-06-30' AND dpd >= 8 THEN 1 ELSE 0 END) AS has_7dpd
  FROM m GROUP BY client_no),
cnt AS (SELECT client_no, CAST(sum(CASE WHEN dpd >= 8 THEN 1 ELSE 0 END) FILTER (m = DATE '1998-06-30') AS BIGINT) AS count_7dpd,
  count(*) FILTER (m = DATE '1998-06-30') AS loans FROM m GROUP BY client_no)
SELECT client_no, has_7dpd, count_7dpd, CASE WHEN loans > 0 THEN count_7dpd::DOUBLE / loans END AS pct_7dpd
FROM ever JOIN cnt USING (client_no)""", ["loan_daily"])
def j1(spark, d):
    """Three blocks over one roll-up are one select, not three frames joined."""
    wide = client_months(loan_daily(spark, d), MONTHS)
    count = F.col(f"`{MONTHS[-1]}_count_7dpd`")
    return wide.select(
        "client_no",
        F.when(count > 0, 1).otherwise(0).alias("has_7dpd"),
        count.alias("count_7dpd"),
        F.col(f"`{MONTHS[-1]}_pct_7dpd`").alias("pct_7dpd"),
    )


@query("j2_attach_chain", """
SELECT client_no, seg_obs, n_loans, n_apps FROM score_input
LEFT JOIN (SELECT client_no, count(*) AS n_loans FROM loan_daily GROUP BY 1) USING (client_no)
LEFT JOIN (SELECT client_no, count(*) AS n_apps FROM applications WHERE status = 'LOAN_FAIL' GROUP BY 1) USING (client_no)""",
       ["score_input", "loan_daily", "applications"])
def j2(spark, d):
    base = score_input(spark, d).select("client_no", "seg_obs")
    failed = applications(spark, d).where(F.col("status") == "LOAN_FAIL")
    parts = [group_count(loan_daily(spark, d), ["client_no"], "n_loans"), group_count(failed, ["client_no"], "n_apps")]
    return attach(base, parts, ["client_no"])


@query("j3_with_group_value", """
SELECT client_no, pt_date, tenor, strftime(min(last_day(disburse_date)) OVER (PARTITION BY client_no), '%Y-%m-%d')
  AS client_start_date FROM accounts""", ["accounts"])
def j3(spark, d):
    rows = accounts(spark, d).select("client_no", "pt_date", "tenor", "disburse_date")
    out = with_group_value(rows, ["client_no"], F.min(F.last_day("disburse_date")), "client_start_date")
    return out.drop("disburse_date").withColumn("client_start_date", F.date_format("client_start_date", "yyyy-MM-dd"))


@query("j4_expand_validity", """
SELECT loan_no, apply_status, apply_date, strftime(day, '%Y-%m-%d') AS pt_date FROM (
  SELECT loan_no, status AS apply_status, strftime(make_timestamp(application_timestamp * 1000), '%Y-%m-%d') AS apply_date,
    dc_start_date, dc_end_date FROM applications) a
JOIN (SELECT CAST(unnest(range(TIMESTAMP '1998-02-20', TIMESTAMP '1998-07-01', INTERVAL 1 DAY)) AS DATE) AS day) c
  ON day >= dc_start_date AND day < dc_end_date""", ["applications"])
def j4(spark, d):
    return application_days(applications(spark, d), LOAN_ANCHOR).select(
        "loan_no", "apply_status", F.date_format("apply_date", "yyyy-MM-dd").alias("apply_date"),
        F.date_format("pt_date", "yyyy-MM-dd").alias("pt_date"),
    )


@query("j4b_expand_all_validity", """
SELECT loan_no, strftime(unnest(range(greatest(dc_start_date, DATE '1997-01-01')::TIMESTAMP,
  least(dc_end_date, DATE '2000-01-01')::TIMESTAMP, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM applications""", ["applications"])
def j4b(spark, d):
    rows = expand_validity(applications(spark, d), "dc_start_date", "dc_end_date", "1997-01-01", "1999-12-31", "day")
    return rows.select("loan_no", F.date_format("day", "yyyy-MM-dd").alias("day"))


_RISK = ", ".join(f"'{w}'" for w in RISK_WORDS)


@query("j5_tag_in_list", f"""
SELECT device_id, app_id, CASE WHEN app_id IN ({_RISK}) THEN 1 ELSE 0 END AS risk_tag, count(*) AS n
FROM app_all GROUP BY ALL""", ["app_all"])
def j5(spark, d):
    rows = app_entries(parse_messages(app_log(spark, d)))
    return tag_in_list(rows, "app_id", RISK_WORDS, "risk_tag").groupBy("device_id", "app_id", "risk_tag").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("j5b_tag_in_table", """
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 1 ELSE 0 END
  AS in_debt FROM orders""")
def j5b(spark, d):
    debt = table(spark, d, "customer").where(F.col("c_acctbal") < 0).select("c_custkey")
    return tag_in_list(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", debt, "in_debt")


@query("j6_lookup_price", """
SELECT event_id, model, brand, last_price_usd FROM (
  SELECT event_id, CASE k % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'LARGE' END AS model, 'brand#' || (user_id % 30) AS brand
  FROM ev)
LEFT JOIN (SELECT model, brand, price_usd_median AS last_price_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY model, brand ORDER BY grass_date DESC, price_usd_median) AS r FROM price)
  WHERE r = 1) USING (model, brand)""", ["ev", "price"])
def j6(spark, d):
    k = F.col("k")
    rows = ev(spark, d).select(
        "event_id", F.when(k % 3 == 0, "PROMO").when(k % 3 == 1, "LARGE").alias("model"),
        F.concat(F.lit("brand#"), (F.col("user_id") % 30).cast("string")).alias("brand"),
    )
    dim = latest_price(price(spark, d)).withColumnRenamed("price_usd_median", "last_price_usd")
    return lookup(rows, dim, ["model", "brand"], ["last_price_usd"])


_LAST = """
l AS (SELECT client_no, device_id FROM (SELECT *, row_number() OVER (PARTITION BY client_no
  ORDER BY days_from_operation, device_id) AS r FROM used) WHERE r = 1)"""


@query("j7_attach_last_entity", f"""WITH {_LAST},
f AS (SELECT CAST(user_id AS VARCHAR) AS device_id, count(*) AS n_events, max(k) AS max_k FROM ev GROUP BY 1)
SELECT client_no, n_events, max_k FROM score_input LEFT JOIN l USING (client_no) LEFT JOIN f USING (device_id)""",
       ["score_input", "used"])
def j7(spark, d):
    features = ev(spark, d).groupBy(F.col("user_id").cast("string").alias("device_id")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("k").alias("max_k")
    )
    last = last_entity(used(spark, d), "client_no", "days_from_operation", "device_id")
    return attach_last_entity(score_input(spark, d), last, features, "client_no", "device_id")


@query("j8_onto_population", """
SELECT client_no, n FROM score_input LEFT JOIN (SELECT client_no, count(*) AS n FROM used GROUP BY 1) USING (client_no)""",
       ["score_input", "used"])
def j8(spark, d):
    return onto_population(score_input(spark, d), group_count(used(spark, d), ["client_no"]), "client_no")


@query("j9_span_to_last_record", f"""WITH
l AS (SELECT client_no, min(days_from_operation) AS last_day FROM used GROUP BY 1)
SELECT client_no, max(days_from_operation - last_day) AS span FROM used JOIN l USING (client_no) GROUP BY 1""", ["used"])
def j9(spark, d):
    return activity_span(used(spark, d), "client_no", "days_from_operation")


@query("j10_any_in_list", """
SELECT event_id, CASE WHEN n = 0 THEN NULL WHEN list_has_any(items, ['click', 'k1', 'k2']) THEN 1 ELSE 0 END AS keep_null,
  CASE WHEN n > 0 AND list_has_any(items, ['view', 'k3']) THEN 1 ELSE 0 END AS or_zero
FROM (SELECT event_id, CASE WHEN k % 6 = 0 THEN 0 ELSE 2 END AS n, [event_type, 'k' || (k % 10)] AS items FROM ev)""", ["ev"])
def j10(spark, d):
    packed = F.when(F.col("k") % 6 != 0, F.concat_ws(",", F.upper("event_type"), F.concat(F.lit("K"), F.col("k") % 10)))
    items = F.split(packed, ",")
    return ev(spark, d).select(
        "event_id",
        any_in_list(items, ["click", "k1", "k2"], "keep").alias("keep_null"),
        any_in_list(items, ["view", "k3"]).alias("or_zero"),
    )


@query("j11_attach_labels", """
SELECT job_id, pt_date, task_table_name, coalesce(busy, 0) AS busy FROM job_run
LEFT JOIN (SELECT task_table_name, CASE WHEN count(*) > 500 THEN 1 ELSE 0 END AS busy FROM job_run
  WHERE task_table_name IS NOT NULL AND final_state = 'FINISHED' GROUP BY 1) USING (task_table_name)""", ["job_run"])
def j11(spark, d):
    runs = job_run(spark, d).select("job_id", "pt_date", "task_table_name", "final_state")
    done = runs.where((F.col("final_state") == "FINISHED") & F.col("task_table_name").isNotNull())
    counts = done.groupBy("task_table_name").agg(F.when(F.count(F.lit(1)) > 500, 1).otherwise(0).alias("busy"))
    return attach_labels(runs.drop("final_state"), counts, "task_table_name")


@query("j12_attach_month_value", """
SELECT a.client_no, a.pt_date, a.tenor, m.worst FROM accounts a
LEFT JOIN (SELECT client_no, pt_date, max(dpd) AS worst FROM accounts GROUP BY ALL) m
  ON m.client_no = a.client_no AND CAST(m.pt_date AS DATE) = last_day(CAST(a.pt_date AS DATE) - to_months(1))""", ["accounts"])
def j12(spark, d):
    rows = accounts(spark, d).select("client_no", "pt_date", "tenor", "dpd")
    monthly = month_rollup(rows, ["client_no"], "pt_date", [F.max("dpd").alias("worst")])
    return attach_month_value(rows.drop("dpd"), monthly, "client_no", "pt_date", "month", -1)


@query("j13_latest_as_of", """
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events
  WHERE ts::DATE <= DATE '2024-01-20') WHERE r = 1""")
def j13(spark, d):
    rows = ev(spark, d).select("user_id", "event_id", "value", "ts")
    out = latest_as_of(
        rows, ["user_id"], [F.desc("ts"), F.asc("event_id")], F.to_date("ts"), F.lit("2024-01-20").cast("date")
    )
    return out.drop("ts")


@query("j13b_as_of_join", """
WITH r AS (SELECT brand, grass_date, min(price_usd_median) AS price FROM price GROUP BY 1, 2),
l AS (SELECT event_id, CASE WHEN k % 20 <> 0 THEN 'brand#' || (user_id % 30) END AS brand,
  CASE WHEN k % 30 <> 1 THEN DATE '2022-12-20' + CAST(event_id % 70 AS INTEGER) END AS day FROM ev)
SELECT event_id, l.brand, strftime(day, '%Y-%m-%d') AS day, strftime(grass_date, '%Y-%m-%d') AS priced_on, price
FROM l ASOF LEFT JOIN r ON l.brand = r.brand AND l.day >= r.grass_date""", ["ev", "price"])
def j13b(spark, d):
    """The price of an event's brand on the event's own day: the last one at or before it."""
    k = F.col("k")
    events = ev(spark, d).select(
        "event_id",
        F.when(k % 20 != 0, F.concat(F.lit("brand#"), (F.col("user_id") % 30).cast("string"))).alias("brand"),
        F.when(k % 30 != 1, F.date_add(F.lit("2022-12-20").cast("date"), (F.col("event_id") % 70).cast("int"))).alias("day"),
    )
    prices = price(spark, d).groupBy("brand", "grass_date").agg(F.min("price_usd_median").alias("price"))
    prices = prices.withColumn("priced_on", F.date_format("grass_date", "yyyy-MM-dd"))
    joined = as_of_join(events, prices, ["brand"], "day", "grass_date", ["priced_on", "price"])
    return joined.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("j4c_valid_counts", """
WITH a AS (SELECT status, dc_start_date AS s, dc_end_date AS e FROM applications WHERE dc_start_date < dc_end_date),
e AS (SELECT status, s AS day, 1 AS step FROM a UNION ALL SELECT status, e, -1 FROM a)
SELECT status, strftime(day, '%Y-%m-%d') AS day, CAST(sum(sum(step)) OVER (PARTITION BY status ORDER BY day) AS BIGINT) AS valid
FROM e GROUP BY status, day""", ["applications"])
def j4c(spark, d):
    """Valid applications by status from day to day, without a row per day of validity."""
    found = valid_counts(applications(spark, d), ["status"], "dc_start_date", "dc_end_date")
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
