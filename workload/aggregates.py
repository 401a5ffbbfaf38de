"""AG* queries."""

from pyspark.sql import functions as F

from creditloom.functions.columns import at_least, count_where, ratio, share, sum_where
from creditloom.functions.dates import month_end_series, month_ends
from creditloom.operators.aggregates import (
    activity_span,
    distinct_per_window,
    distinct_rows,
    first_month,
    group_count,
    month_rollup,
    pivot_months,
    rollup_flags,
    streak,
    tag_counts,
    with_row_count,
)
from creditloom.operators.joins import tag_in_list
from creditloom.operators.projections import sum_columns
from creditloom.operators.windows import daily_top_flags, dedup
from creditloom.plans.apps import app_entries, parse_messages
from creditloom.plans.devices import client_devices
from workload.base import query, table
from workload.standins import (
    ACTION_ANCHOR,
    LOAN_ANCHOR,
    RISK_WORDS,
    accounts,
    actions,
    app_log,
    ev,
    job_run,
    loan_daily,
)

MONTHS = month_ends(LOAN_ANCHOR)
WINDOWS = (7, 14, 21, 30)


def used(spark, d):
    return client_devices(actions(spark, d), ACTION_ANCHOR, 30, "pt_date")


@query("ag1_month_rollup", """
SELECT client_no, loan_no, strftime(last_day(CAST(pt_date AS DATE)), '%Y-%m-%d') AS month, max(day_past_due) AS day_past_due
FROM loan_daily GROUP BY ALL""", ["loan_daily"])
def ag1(spark, d):
    rows = month_rollup(
        loan_daily(spark, d), ["client_no", "loan_no"], "pt_date", [F.max("day_past_due").alias("day_past_due")]
    )
    return rows.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query("ag2_month_balance", """
SELECT client_no, strftime(last_day(CAST(pt_date AS DATE)), '%Y-%m-%d') AS month,
  round(CAST(sum(CAST(floor(b * 100) AS BIGINT)) AS DOUBLE) / count(b), 4) AS cents_mtd
FROM (SELECT *, outstanding_principal + outstanding_interest + outstanding_fee AS b FROM loan_daily)
WHERE b > 0 GROUP BY ALL""", ["loan_daily"])
def ag2(spark, d):
    parts = ["outstanding_principal", "outstanding_interest", "outstanding_fee"]
    rows = sum_columns(loan_daily(spark, d), parts, "cur_balance")
    cents = F.floor(F.col("cur_balance") * 100)
    out = month_rollup(
        rows, ["client_no"], "pt_date", [F.round(F.avg(cents), 4).alias("cents_mtd")], where=F.col("cur_balance") > 0
    )
    return out.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


def _month_sql(template):
    return ", ".join(template.format(m=m) for m in MONTHS)


@query("ag3_pivot_months", "SELECT client_no, " + _month_sql("""
  CAST(count(*) FILTER (m = DATE '{m}') AS BIGINT) AS n_{m}""".replace("n_{m}", '"{m}_rows_or_zero"')) + ", " + _month_sql("""
  CASE WHEN count(*) FILTER (m = DATE '{m}') > 0 THEN count(day_past_due) FILTER (m = DATE '{m}') END AS "{m}_known",
  max(day_past_due) FILTER (m = DATE '{m}') AS "{m}_worst",
  CAST(sum(day_past_due) FILTER (m = DATE '{m}') AS BIGINT) AS "{m}_total"
""") + " FROM (SELECT *, last_day(CAST(pt_date AS DATE)) AS m FROM loan_daily) GROUP BY client_no", ["loan_daily"])
def ag3(spark, d):
    rows = loan_daily(spark, d).withColumn("month", F.last_day("pt_date"))
    dpd = F.col("day_past_due")
    out = pivot_months(rows, ["client_no"], "month", MONTHS, {
        "rows_or_zero": ("count", F.lit(1)), "known": ("count", dpd), "worst": ("max", dpd), "total": ("sum", dpd),
    })
    return out.withColumns({f"{m}_rows_or_zero": F.coalesce(F.col(f"`{m}_rows_or_zero`"), F.lit(0)) for m in MONTHS})


@query("ag4_pivot_sparse_months", "SELECT user_id, " + ", ".join(f"""
  max(k) FILTER (last_day(ts::DATE) = DATE '{m}') AS "{m}_k" """ for m in ("2023-12-31", "2024-01-31", "2024-02-29"))
       + " FROM ev GROUP BY user_id", ["ev"])
def ag4(spark, d):
    """Months without any row still get their column, because the months are given."""
    rows = ev(spark, d).withColumn("month", F.last_day("ts"))
    return pivot_months(rows, ["user_id"], "month", ["2023-12-31", "2024-01-31", "2024-02-29"], {"k": ("max", F.col("k"))})


@query("ag5_conditional_sums", """
SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS BIGINT) AS returned_lines,
  count(*) FILTER (l_quantity > 25) AS large_lines FROM lineitem GROUP BY l_suppkey""")
def ag5(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        sum_where(F.col("l_returnflag") == "R", F.col("l_linenumber")).alias("returned_lines"),
        count_where(F.col("l_quantity") > 25).alias("large_lines"),
    )


@query("ag6_ratio_of_counts", """
SELECT client_no, late, known, CASE WHEN known > 0 THEN late::DOUBLE / known END AS pct
FROM (SELECT client_no, count(*) FILTER (day_past_due >= 31) AS late,
        count(day_past_due) FILTER (product_type = 'N') AS known FROM loan_daily GROUP BY client_no)""", ["loan_daily"])
def ag6(spark, d):
    dpd = F.col("day_past_due")
    counts = loan_daily(spark, d).groupBy("client_no").agg(
        F.sum(at_least(dpd, 31)).alias("late"),
        count_where(dpd.isNotNull() & (F.col("product_type") == "N")).alias("known"),
    )
    return counts.withColumn("pct", ratio(F.col("late"), F.col("known")))


@query("ag7_share_of_known", """
SELECT user_id, count(*) FILTER (b >= 90)::DOUBLE / nullif(count(b), 0) AS ge_90_ratio
FROM (SELECT user_id, CASE WHEN k % 7 <> 0 THEN k END AS b FROM ev) GROUP BY user_id""", ["ev"])
def ag7(spark, d):
    rows = ev(spark, d).select("user_id", F.when(F.col("k") % 7 != 0, F.col("k")).alias("b"))
    return rows.groupBy("user_id").agg(share(F.col("b") >= 90, F.col("b")).alias("ge_90_ratio"))


@query("ag8_distinct_per_window", "SELECT client_no, " + ", ".join(f"""
  count(DISTINCT device_id) FILTER (days_from_operation < {w}) AS distinct_device_cnt_{w}d,
  CASE WHEN count(*) FILTER (days_from_operation < {w}) = 0 THEN -999998::DOUBLE
    ELSE count(DISTINCT device_id) FILTER (days_from_operation < {w})::DOUBLE
      / count(*) FILTER (days_from_operation < {w}) END AS distinct_device_cnt_norm_{w}d""" for w in WINDOWS)
       + " FROM used GROUP BY client_no", ["used"])
def ag8(spark, d):
    return distinct_per_window(used(spark, d), "client_no", "device_id", "days_from_operation", WINDOWS)


@query("ag9_group_as_distinct", "SELECT client_no, device_id, days_from_operation FROM used", ["used"])
def ag9(spark, d):
    return used(spark, d)


@query("ag10_distinct_rows", """
SELECT DISTINCT client_no, loan_no, product_type, tenor,
  strftime(last_day(loan_disbursement_date), '%Y-%m-%d') AS month FROM loan_daily""", ["loan_daily"])
def ag10(spark, d):
    rows = loan_daily(spark, d).select(
        "client_no", "loan_no", "product_type", "tenor",
        F.date_format(F.last_day("loan_disbursement_date"), "yyyy-MM-dd").alias("month"),
    )
    return distinct_rows(rows)


@query("ag11_keyed_dedup", """
SELECT user_id, day, event_id, value FROM (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, value,
    row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def ag11(spark, d):
    rows = ev(spark, d).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value")
    return dedup(rows, ["user_id", "day"], [F.desc("value"), F.asc("event_id")])


@query("ag12_group_count", "SELECT client_no, device_id, count(*) AS n FROM used GROUP BY ALL", ["used"])
def ag12(spark, d):
    return group_count(used(spark, d), ["client_no", "device_id"])


@query("ag13_activity_span", """
SELECT client_no, max(days_from_operation) - min(days_from_operation) AS span FROM used GROUP BY client_no""", ["used"])
def ag13(spark, d):
    return activity_span(used(spark, d), "client_no", "days_from_operation")


@query("ag14_first_month", """
SELECT client_no, strftime(min(last_day(disburse_date)), '%Y-%m-%d') AS first_month FROM accounts GROUP BY client_no""",
       ["accounts"])
def ag14(spark, d):
    out = first_month(accounts(spark, d), "client_no", "disburse_date")
    return out.withColumn("first_month", F.date_format("first_month", "yyyy-MM-dd"))


@query("ag15_month_end_max", """
SELECT client_no, pt_date AS month, max(dpd) AS dpd_pre_mend FROM accounts GROUP BY ALL""", ["accounts"])
def ag15(spark, d):
    out = month_rollup(accounts(spark, d), ["client_no"], "pt_date", [F.max("dpd").alias("dpd_pre_mend")])
    return out.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


_RISK = ", ".join(f"'{w}'" for w in RISK_WORDS)


@query("ag16_tag_counts", f"""
SELECT device_id, count(*) FILTER (coalesce(app_id, '') IN ({_RISK})) AS risky FROM app_all GROUP BY device_id""",
       ["app_all"])
def ag16(spark, d):
    rows = app_entries(parse_messages(app_log(spark, d)))
    return tag_counts(tag_in_list(rows, "app_id", RISK_WORDS, "risk_tag"), "device_id", "risk_tag", "risky")


@query("ag17_row_count_column", """
SELECT client_no, count(*) AS n, (SELECT count(DISTINCT client_no) FROM loan_daily) AS client_count
FROM loan_daily GROUP BY client_no""", ["loan_daily"])
def ag17(spark, d):
    rows = loan_daily(spark, d)
    per_client = group_count(rows, ["client_no"])
    return with_row_count(per_client, rows.select("client_no").distinct(), "client_count")


_TOP = """
j AS (SELECT pt_date, job_id, task_table_name, app_queue, elapsed_time_min, memory_gb_hour FROM (
  SELECT *, row_number() OVER (PARTITION BY pt_date, job_id ORDER BY started_date DESC) AS r FROM job_run) WHERE r = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY pt_date ORDER BY coalesce(memory_gb_hour, 0) DESC, job_id) AS r
  FROM j),
f AS (SELECT task_table_name, pt_date, CASE WHEN r <= 40 THEN 1 ELSE 0 END AS mu_top40,
  CASE WHEN r <= 10 THEN 1 ELSE 0 END AS mu_top10 FROM t),
g AS (SELECT task_table_name, pt_date, max(mu_top40) AS mu_top40, max(mu_top10) AS mu_top10 FROM f GROUP BY ALL)"""


def top_flags(spark, d):
    jobs = dedup(job_run(spark, d), ["pt_date", "job_id"], [F.desc("started_date")])
    jobs = jobs.select("pt_date", "job_id", "task_table_name", "memory_gb_hour")
    return daily_top_flags(jobs, "pt_date", "job_id", {"mu": ("memory_gb_hour", None)}, [40, 10])


@query("ag18_rollup_flags", f"WITH {_TOP} SELECT * FROM g", ["job_run"])
def ag18(spark, d):
    return rollup_flags(top_flags(spark, d), ["task_table_name", "pt_date"], ["mu_top40", "mu_top10"])


@query("ag19_streak", f"""WITH {_TOP}
SELECT task_table_name, CASE WHEN count(*) = 7 AND sum(mu_top40) = 7 THEN 1 ELSE 0 END AS mu_top40,
  CASE WHEN count(*) = 7 AND sum(mu_top10) = 7 THEN 1 ELSE 0 END AS mu_top10
FROM g WHERE pt_date BETWEEN '2024-01-22' AND '2024-01-28' GROUP BY task_table_name""", ["job_run"])
def ag19(spark, d):
    week = top_flags(spark, d).where(F.col("pt_date").between("2024-01-22", "2024-01-28"))
    return streak(week, "task_table_name", "pt_date", ["mu_top40", "mu_top10"], 7)


@query("ag20_month_ends", """
SELECT o_orderkey, i AS pos, strftime(last_day(o_orderdate::DATE - to_months(4 - i)), '%Y-%m-%d') AS month
FROM orders, (SELECT CAST(unnest(range(5)) AS INTEGER) AS i)""")
def ag20(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.posexplode(month_end_series(F.to_date("o_orderdate"))).alias("pos", "month")
    )
    return rows.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


