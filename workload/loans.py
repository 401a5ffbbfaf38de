"""FF*, PL1-PL3, PL13 queries."""

from pyspark.sql import functions as F

from creditloom.functions.dates import month_end, month_ends
from creditloom.operators.joins import attach
from creditloom.plans.loans import (
    DPD_CLASSES,
    build_sample,
    client_months,
    delinquency_spec,
    disbursement_spec,
    failed_application_features,
    loan_features,
    loan_window,
    month_features,
    months_on_book,
    segment,
)
from workload.base import query
from workload.standins import LOAN_ANCHOR, accounts, applications, loan_daily

MONTHS = month_ends(LOAN_ANCHOR)
VALUES = [f"{v}_{c}" for v in ("count", "pct") for c in DPD_CLASSES]


def _back(i):
    return month_end(LOAN_ANCHOR, i).isoformat()


def _columns_sql():
    """Month columns per client, as SQL over loan months and disbursements."""
    out = []
    for m in MONTHS:
        here = f"FILTER (m = DATE '{m}')"
        out.append(f'count(*) {here} AS "{m}_rows"')
        out += [
            f'CASE WHEN count(*) {here} > 0 THEN count(*) FILTER (m = DATE \'{m}\' AND dpd >= {low}) END AS "{m}_count_{c}"'
            for c, low in DPD_CLASSES.items()
        ]
    return ", ".join(out)


def _pct_sql():
    return ", ".join(
        f'"{m}_count_{c}"::DOUBLE / nullif("{m}_rows", 0) AS "{m}_pct_{c}"' for m in MONTHS for c in DPD_CLASSES
    )


def _disb_sql():
    return ", ".join(
        f"CASE WHEN count(*) FILTER (dm = DATE '{m}') > 0 THEN count(loan_no) FILTER (dm = DATE '{m}') END"
        f' AS "{m}_loan_disbursement_count",'
        f" CAST(sum(loan_disb) FILTER (dm = DATE '{m}') AS DOUBLE) AS \"{m}_loan_disbursement_amount\""
        for m in MONTHS
    )


COLUMNS = f"""
lw AS (SELECT * FROM loan_daily WHERE pt_date BETWEEN '1998-02-20' AND '1998-06-30' AND prod_type IN ('101', '102', '120')),
lm AS (SELECT client_no, loan_no, last_day(CAST(pt_date AS DATE)) AS m, max(day_past_due) AS dpd FROM lw GROUP BY ALL),
c0 AS (SELECT client_no, {_columns_sql()} FROM lm GROUP BY client_no),
c1 AS (SELECT *, {_pct_sql()} FROM c0),
dd AS (SELECT DISTINCT client_no, loan_no, product_type, tenor, loan_disb, last_day(loan_disbursement_date) AS dm FROM lw),
d1 AS (SELECT client_no, {_disb_sql()} FROM dd GROUP BY client_no),
cols AS (SELECT * FROM c1 JOIN d1 USING (client_no))"""


def _feature_sql(family, suffix, n):
    col = [f'"{_back(i)}_{suffix}"' for i in range(5)]
    span = col[:n]
    if family == "ever":
        return "CASE WHEN " + " OR ".join(f"coalesce({c}, 0) > 0" for c in span) + " THEN 1 ELSE 0 END"
    if family in ("max", "min"):
        fn = {"max": "list_max", "min": "list_min"}[family]
        return f"{fn}([{', '.join(span)}])"
    if family == "sum_nullable" and n == 1:
        return span[0]
    if family in ("sum", "sum_nullable"):
        return " + ".join(f"coalesce({c}, 0)" for c in span)
    if family == "change":
        return f"coalesce({col[n - 1]} - {col[n]}, 0)"
    return f"coalesce({col[n - 1]}::DOUBLE / nullif({col[n]}, 0)::DOUBLE - 1.0::DOUBLE, 0.0::DOUBLE)"


def feature_list_sql(spec):
    return ", ".join(f'{_feature_sql(*what)} AS "{alias}"' for alias, what in spec.items())


def _select(spec):
    return f"WITH {COLUMNS} SELECT client_no, {feature_list_sql(spec)} FROM cols"


def _family(spec, *families):
    return {alias: what for alias, what in spec.items() if what[0] in families}


_DPD, _DISB = delinquency_spec(), disbursement_spec()
_ALL = {**_DPD, **_DISB}


def _register(name, spec):
    @query(name, _select(spec), ["loan_daily"])
    def run(spark, d):
        wide = client_months(loan_window(loan_daily(spark, d), LOAN_ANCHOR), MONTHS)
        return month_features(wide, LOAN_ANCHOR, MONTHS, spec, ["client_no"])


_register("ff1_ever", _family(_ALL, "ever"))
_register("ff2_max", _family(_ALL, "max"))
_register("ff3_min", _family(_ALL, "min"))
_register("ff4_sum", _family(_ALL, "sum", "sum_nullable"))
_register("ff5_change", _family(_ALL, "change"))
_register("ff6_change_ratio", _family(_ALL, "change_ratio"))


@query("ff_all_loan_features", f"WITH {COLUMNS} SELECT client_no, '{LOAN_ANCHOR}' AS pt_date, {feature_list_sql(_ALL)} FROM cols",
       ["loan_daily"])
def ff_all(spark, d):
    return loan_features(loan_daily(spark, d), LOAN_ANCHOR)


SAMPLE = """
r AS (SELECT * FROM accounts WHERE repayment_status <> 'REFUND' AND sub_prod_code IN ('101', '102', '120')
  AND pt_date = '1998-06-30'),
f AS (SELECT client_no, min(last_day(disburse_date)) AS first FROM r GROUP BY client_no),
g AS (SELECT client_no, max(dpd) AS dpd_pre_mend FROM r GROUP BY client_no),
smp AS (SELECT DISTINCT client_no, '1998-06-30' AS pt_date,
    ((1998 * 12 + 6) - (year(first) * 12 + month(first)) + 1)::DOUBLE AS mob,
    CASE WHEN dpd_pre_mend > 0 THEN 'xdpd' ELSE '0dpd' END AS seg_obs
  FROM r JOIN f USING (client_no) JOIN g USING (client_no)
  WHERE (1998 * 12 + 6) - (year(first) * 12 + month(first)) + 1 >= 0)"""


@query("pl1_months_on_book", """
SELECT client_no, pt_date, tenor, ((year(p) * 12 + month(p)) - (year(disburse_date) * 12 + month(disburse_date)) + 1)::DOUBLE
  AS mob FROM (SELECT *, CAST(pt_date AS DATE) AS p FROM accounts)""", ["accounts"])
def pl1(spark, d):
    mob = months_on_book(F.col("pt_date").cast("date"), F.col("disburse_date"))
    return accounts(spark, d).select("client_no", "pt_date", "tenor", mob.alias("mob"))


@query("pl2_segment", """
SELECT client_no, pt_date, CASE WHEN max(dpd) > 0 THEN 'xdpd' ELSE '0dpd' END AS seg_obs FROM accounts GROUP BY ALL""",
       ["accounts"])
def pl2(spark, d):
    worst = accounts(spark, d).groupBy("client_no", "pt_date").agg(F.max("dpd").alias("dpd"))
    return worst.select("client_no", "pt_date", segment(F.col("dpd")).alias("seg_obs"))


@query("pl3_build_sample", f"WITH {SAMPLE} SELECT * FROM smp", ["accounts"])
def pl3(spark, d):
    return build_sample(accounts(spark, d), LOAN_ANCHOR)


@query("pl3_loan_sample_with_features", f"""WITH {COLUMNS}, {SAMPLE}
SELECT client_no, pt_date, mob, seg_obs, {feature_list_sql(_DPD)} FROM smp LEFT JOIN cols USING (client_no)""",
       ["loan_daily", "accounts"])
def pl3_features(spark, d):
    features = loan_features(loan_daily(spark, d), LOAN_ANCHOR, _DPD)
    return attach(build_sample(accounts(spark, d), LOAN_ANCHOR), [features], ["client_no", "pt_date"])


def _appl_sql():
    from creditloom.plans.loans import failed_application_spec

    cols = ", ".join(
        f"CASE WHEN count(*) FILTER (m = DATE '{m}') > 0 THEN count(*) FILTER (m = DATE '{m}') END"
        f' AS "{m}_ft_loanappl_count_fail", max(1) FILTER (m = DATE \'{m}\') AS "{m}_ft_loanappl_ind_fail"'
        for m in MONTHS
    )
    return f"""WITH a AS (
  SELECT DISTINCT client_no, loan_no, last_day(make_timestamp(application_timestamp * 1000)::DATE) AS m FROM applications
  JOIN (SELECT CAST(unnest(range(TIMESTAMP '1998-02-20', TIMESTAMP '1998-07-01', INTERVAL 1 DAY)) AS DATE) AS day) c
    ON day >= dc_start_date AND day < dc_end_date WHERE status = 'LOAN_FAIL'),
cols AS (SELECT client_no, {cols} FROM a GROUP BY client_no)
SELECT client_no, '{LOAN_ANCHOR}' AS pt_date, {feature_list_sql(failed_application_spec())} FROM cols"""


@query("pl13_failed_applications", _appl_sql(), ["applications"])
def pl13(spark, d):
    return failed_application_features(applications(spark, d), LOAN_ANCHOR)
