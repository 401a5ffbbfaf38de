"""PL4-PL8, PL12, IO8 and IO9 queries."""

import uuid

from pyspark.sql import functions as F

from creditloom.functions.columns import log_odds, null_where
from creditloom.plans import registry
from creditloom.plans.loans import MODEL_FEATURES
from creditloom.plans.scoring import (
    INTERCEPT,
    loan_score,
    pack_json,
    score,
    score_with_model,
    scored_clients,
    unmatched_values,
    woe_encode,
)
from creditloom.session import scratch_path
from creditloom.sources.scans import WOE_SCHEMA, load_scorer, load_woe
from workload.base import TWINS, query, table
from workload.devices import WINDOWS, rounded
from workload.jobs import KS
from workload.loans import COLUMNS, SAMPLE, _feature_sql, delinquency_spec, disbursement_spec
from workload.standins import (
    ACTION_ANCHOR,
    APP_ANCHOR,
    APP_TODAY,
    JOB_DAY,
    LISTS,
    LOAN_ANCHOR,
    RISK_WORDS,
    accounts,
    actions,
    app_log,
    applications,
    device_raw,
    job_run,
    loan_daily,
    price,
    score_input,
)


def rule(feature, stage, ord_, op, out, lo=None, hi=None, values=None):
    return {"feature": feature, "stage": stage, "ord": ord_, "op": op, "lo": lo, "hi": hi, "values": values, "out": out}


RULES = [
    rule("ft_balance", "bin", 1, "is_null", -1.0),
    rule("ft_balance", "bin", 2, "lt", 0.0, hi=0.0),
    rule("ft_balance", "bin", 3, "between", 1.0, lo=0.0, hi=5000.0),
    rule("ft_balance", "bin", 4, "else", 2.0),
    rule("ft_balance", "woe", 1, "in", 0.25, values=["-1.0"]),
    rule("ft_balance", "woe", 2, "le", 0.75, hi=0.0),
    rule("ft_balance", "woe", 3, "in", -0.125, values=["1.0", "9.0"]),
    rule("ft_balance", "woe", 4, "else", -0.5),
    rule("ft_orders", "bin", 1, "lt", 0.0, hi=8.0),
    rule("ft_orders", "bin", 2, "between", 1.0, lo=8.0, hi=12.0),
    rule("ft_orders", "woe", 1, "le", 0.5, hi=0.0),
    rule("ft_orders", "woe", 2, "is_null", -0.75),
    rule("ft_orders", "woe", 3, "else", 0.125),
]
COEF = {INTERCEPT: -1.5, "ft_balance": 1.25, "ft_orders": -0.5}

LOAN_RULES = [
    r
    for f in MODEL_FEATURES
    for r in (
        rule(f, "bin", 1, "is_null", -1.0),
        rule(f, "bin", 2, "lt", 0.0, hi=0.5),
        rule(f, "bin", 3, "between", 1.0, lo=0.5, hi=2.5),
        rule(f, "bin", 4, "else", 2.0),
        rule(f, "woe", 1, "le", 0.25, hi=0.0),
        rule(f, "woe", 2, "in", -0.125, values=["1.0"]),
        rule(f, "woe", 3, "else", -0.5),
    )
]
LOAN_COEF = {INTERCEPT: -2.0, **{f: 0.25 * (i + 1) for i, f in enumerate(MODEL_FEATURES)}}

_WOE = """
w AS (SELECT client_no, seg_obs,
  CASE WHEN ft_balance IS NULL THEN 0.25 WHEN ft_balance < 0 THEN 0.75 WHEN ft_balance <= 5000 THEN -0.125
    ELSE -0.5 END::DOUBLE AS ft_balance,
  CASE WHEN ft_orders < 8 THEN 0.5 WHEN ft_orders <= 12 THEN 0.125 ELSE -0.75 END::DOUBLE AS ft_orders FROM score_input)"""
_PD = "1.0::DOUBLE / (1.0::DOUBLE + exp(-(-1.5::DOUBLE + 1.25::DOUBLE * ft_balance + -0.5::DOUBLE * ft_orders)))"


def encoded(spark, d):
    return woe_encode(score_input(spark, d), RULES, ["client_no", "seg_obs"])


@query("pl4_woe_encode", f"WITH {_WOE} SELECT * FROM w", ["score_input"])
def pl4(spark, d):
    return encoded(spark, d)


@query("pl4_boundary_search", """
SELECT o_orderkey, CASE WHEN o_totalprice < 1000000 THEN floor(o_totalprice / 100)::DOUBLE END AS price,
  CASE WHEN o_orderkey % 7 = 0 AND o_orderkey < 140000 THEN 0.5 WHEN o_orderkey < 4000 THEN 1.5 END::DOUBLE AS key FROM orders""")
def pl4_search(spark, d):
    """Ten thousand rules for one feature: a bin for every hundred of the price, as one search."""
    prices = [rule("price", "bin", i, "lt", i, hi=100.0 * (i + 1)) for i in range(10_000)]
    sevens = rule("key", "bin", 0, "in", 0.5, values=[str(k) for k in range(0, 140_000, 7)])
    keys = [sevens, *[rule("key", "bin", i, "lt", 1.5, hi=100.0 * i) for i in range(1, 41)]]
    woe = [rule("price", "woe", i, "between", i, lo=i, hi=i) for i in range(10_000)]
    woe += [rule("key", "woe", 1, "le", 0.5, hi=0.5), rule("key", "woe", 2, "le", 1.5, hi=1.5)]
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key"))
    return woe_encode(orders, prices + keys + woe, ["o_orderkey"])


@query("pl4_unmatched", """
SELECT 'ft_balance' AS feature, 'bin' AS stage, 0::BIGINT AS unmatched UNION ALL SELECT 'ft_balance', 'woe', 0
UNION ALL SELECT 'ft_orders', 'bin', count(*) FILTER (ft_orders IS NULL OR ft_orders > 12) FROM score_input
UNION ALL SELECT 'ft_orders', 'woe', 0""", ["score_input"])
def pl4_unmatched(spark, d):
    return unmatched_values(score_input(spark, d), RULES)


@query("pl5_score", f"WITH {_WOE} SELECT client_no, round({_PD}, 10) AS pd FROM w", ["score_input"])
def pl5(spark, d):
    return score(encoded(spark, d), COEF).select("client_no", F.round("pd", 10).alias("pd"))


@query("pl6_log_odds", f"""WITH {_WOE} SELECT client_no, CASE WHEN seg_obs = 'BUILDING' THEN NULL
  ELSE round(ln(pd / (1.0::DOUBLE - pd)), 9) END AS logodds FROM (SELECT *, {_PD} AS pd FROM w)""", ["score_input"])
def pl6(spark, d):
    odds = null_where(F.col("seg_obs") == "BUILDING", log_odds(F.col("pd")))
    return score(encoded(spark, d), COEF).select("client_no", F.round(odds, 9).alias("logodds"))


@query("pl7_pack_json")
def pl7(spark, d):
    return pack_json(score_input(spark, d), ["ft_balance", "ft_orders"], "features")


@query("pl7_packed_values", "SELECT client_no, ft_balance, ft_orders FROM score_input", ["score_input"])
def pl7_values(spark, d):
    """The packed values, read back from the JSON."""
    rows = score_input(spark, d)
    cols = ["ft_balance", "ft_orders"]
    packed = pack_json(rows, cols, "features")
    return packed.select("client_no", F.from_json("features", rows.select(*cols).schema).alias("f")).select("client_no", "f.*")


def _loan_score_sql():
    spec = {**delinquency_spec(), **disbursement_spec()}
    raw = ", ".join(f"coalesce({_feature_sql(*spec[f])}, 0) AS {f}" for f in MODEL_FEATURES)
    woe = ", ".join(
        f"CASE WHEN {f} < 0.5 THEN 0.25 WHEN {f} <= 2.5 THEN -0.125 ELSE -0.5 END::DOUBLE AS {f}_woe" for f in MODEL_FEATURES
    )
    linear = " + ".join(f"{LOAN_COEF[f]}::DOUBLE * {f}_woe" for f in MODEL_FEATURES)
    return f"""WITH {COLUMNS}, {SAMPLE},
x AS (SELECT client_no, pt_date, mob, seg_obs, {raw} FROM smp LEFT JOIN cols USING (client_no)),
y AS (SELECT *, {woe} FROM x),
z AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(-2.0::DOUBLE + {linear}))) AS p FROM y)"""


@query("pl8_scored_clients", _loan_score_sql() + """
SELECT * EXCLUDE (p), round(p, 10) AS pd, CASE WHEN seg_obs <> 'xdpd' THEN round(ln(p / (1.0::DOUBLE - p)), 9) END AS logodds
FROM z""", ["loan_daily", "accounts"])
def pl8_scored(spark, d):
    out = scored_clients(loan_daily(spark, d), accounts(spark, d), LOAN_ANCHOR, LOAN_RULES, LOAN_COEF)
    return out.withColumns({"pd": F.round("pd", 10), "logodds": F.round("logodds", 9)})


@query("pl8_loan_score", _loan_score_sql() + """
SELECT client_no, round(p, 10) AS pd, CASE WHEN seg_obs <> 'xdpd' THEN round(ln(p / (1.0::DOUBLE - p)), 9) END AS logodds,
  '1998-06-30' AS offline_score_date, (SELECT count(*) FROM z) AS client_count, '1998-06-30' AS pt_date FROM z""",
       ["loan_daily", "accounts"])
def pl8(spark, d):
    """Without the packed JSON column, whose text form has no SQL twin."""
    out = loan_score(loan_daily(spark, d), accounts(spark, d), LOAN_ANCHOR, LOAN_RULES, LOAN_COEF).drop("features")
    return out.withColumns({"pd": F.round("pd", 10), "logodds": F.round("logodds", 9)})


@query("pl8_score_table")
def pl8_table(spark, d):
    return loan_score(loan_daily(spark, d), accounts(spark, d), LOAN_ANCHOR, LOAN_RULES, LOAN_COEF)


def published(spark, name, tables, anchor, params=None):
    """A registered job run into a table of its own; the table."""
    table_name = f"{name}_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, table_name)
    registry.run(name, tables, anchor, table_name, params, path)
    return spark.table(table_name)


@query("pl8_score_job", _loan_score_sql() + """
SELECT * EXCLUDE (p, mob, seg_obs), round(p, 10) AS pd, CASE WHEN seg_obs <> 'xdpd' THEN round(ln(p / (1.0::DOUBLE - p)), 9) END AS logodds,
  '1998-06-30' AS offline_score_date, (SELECT count(*) FROM z) AS client_count FROM z""", ["loan_daily", "accounts"])
def pl8_job(spark, d):
    """The registered score job: its partition written, read back, and the packed features unpacked."""
    tables = {"loan_daily": loan_daily(spark, d), "accounts": accounts(spark, d)}
    params = {"rules": LOAN_RULES, "coef": LOAN_COEF}
    written = published(spark, "loan_score", tables, LOAN_ANCHOR, params)
    scored = scored_clients(tables["loan_daily"], tables["accounts"], LOAN_ANCHOR, LOAN_RULES, LOAN_COEF)
    packed = scored.select(*[c for c in scored.columns if c.startswith("ft_")]).schema
    out = written.withColumn("f", F.from_json("features", packed))
    return out.select(
        "client_no", "pt_date", F.round("pd", 10).alias("pd"), F.round("logodds", 9).alias("logodds"),
        "offline_score_date", "client_count", "f.*",
    )


def _dated(name, anchor):
    """The SQL twin of a job's query, with the job's date."""
    return f"SELECT *, '{anchor}' AS pt_date FROM ({TWINS[name]})"


@query("pl12_registry_loan_status", TWINS["ff_all_loan_features"])
def pl12_loans(spark, d):
    return published(spark, "ft_loan_status", {"loan_daily": loan_daily(spark, d)}, LOAN_ANCHOR)


@query("pl12_registry_failed_application", TWINS["pl13_failed_applications"])
def pl12_failed(spark, d):
    return published(spark, "ft_failed_application", {"application_scd2": applications(spark, d)}, LOAN_ANCHOR)


@query("pl12_registry_device", _dated("pl10_device_features", ACTION_ANCHOR))
def pl12_device(spark, d):
    tables = {"device_raw": device_raw(spark, d), "price": price(spark, d)}
    return rounded(published(spark, "ft_device", tables, ACTION_ANCHOR, {"lists": LISTS, "windows": WINDOWS}), "")


@query("pl12_registry_device_user", _dated("pl10_device_features_by_client", ACTION_ANCHOR))
def pl12_device_user(spark, d):
    tables = {
        "device_raw": device_raw(spark, d), "price": price(spark, d), "action_log": actions(spark, d),
        "population": score_input(spark, d),
    }
    params = {"lists": LISTS, "windows": WINDOWS, "part": "pt_date"}
    return rounded(published(spark, "ft_device_user_level", tables, ACTION_ANCHOR, params), "last_")


@query("pl12_registry_app", _dated("pl11_app_features", APP_ANCHOR))
def pl12_app(spark, d):
    params = {"as_of": APP_TODAY, "risk_apps": RISK_WORDS, "history_days": 20}
    return published(spark, "ft_app_device_level", {"app_log": app_log(spark, d)}, APP_ANCHOR, params)


@query("pl12_registry_job_health", _dated("lb_job_health_labels", JOB_DAY))
def pl12_jobs(spark, d):
    return published(spark, "job_health", {"job_run": job_run(spark, d)}, JOB_DAY, {"ks": KS})


def fitted(spark, d, path):
    """The encoded customers with a label, and a small model fitted on them and saved below ``path``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = encoded(spark, d).withColumn("label", F.when(F.col("seg_obs") == "BUILDING", 1.0).otherwise(0.0))
    assembler = VectorAssembler(inputCols=["ft_balance", "ft_orders"], outputCol="features")
    model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=25).fit(assembler.transform(rows))
    assembler.save(f"{path}/vector_assembler")
    model.save(f"{path}/model")
    return rows


@query("io8_load_scorer")
def io8(spark, d):
    """Fit a small model on the given customers, save it, load it back and score with it."""
    path = scratch_path(spark, "model")
    rows = fitted(spark, d, path)
    return score_with_model(rows, *load_scorer(path)).select("client_no", F.round("pd", 9).alias("pd"))


@query("io8_saved_coefficients", f"WITH {_WOE} SELECT client_no, TRUE AS same, round({_PD}, 9) AS pd FROM w", ["score_input"])
def io8_saved(spark, d):
    """The loaded model against the formula of its own coefficients, and the formula with the given ones."""
    path = scratch_path(spark, "model")
    rows = fitted(spark, d, path)
    assembler, model = load_scorer(path)
    own = {INTERCEPT: float(model.intercept), **dict(zip(assembler.getInputCols(), map(float, model.coefficients)))}
    by_model = score_with_model(rows, assembler, model, "by_model")
    both = score(score(by_model, own, "by_formula"), COEF)
    same = F.abs(F.col("by_model") - F.col("by_formula")) < 1e-12
    return both.select("client_no", same.alias("same"), F.round("pd", 9).alias("pd"))


@query("io9_load_woe", f"WITH {_WOE} SELECT * FROM w", ["score_input"])
def io9(spark, d):
    """The rules go through a Parquet rule table and back before they encode the customers."""
    path = scratch_path(spark, "woe")
    names = [c.split(" ")[0].strip("`") for c in WOE_SCHEMA.split(", ")]
    spark.createDataFrame([tuple(r[n] for n in names) for r in RULES], WOE_SCHEMA).coalesce(1).write.parquet(path)
    return woe_encode(score_input(spark, d), load_woe(spark, path), ["client_no", "seg_obs"])
