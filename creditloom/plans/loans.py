"""Loan behaviour features, the scoring sample, and failed applications."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.columns import exact_sum, ladder, ratio
from creditloom.functions.dates import as_date, from_epoch_ms, lit_date, month_ends, whole_months_between
from creditloom.functions.months import month_feature
from creditloom.operators.aggregates import pivot_months
from creditloom.operators.joins import expand_validity
from creditloom.sources.scans import scan_window

# Days past due from which a loan counts in a class.
DPD_CLASSES = {"xdpd": 1, "7dpd": 8, "15dpd": 16, "30dpd": 31}

# Product codes of the scored loans.
PRODUCTS = ["101", "102", "120"]

# The features of the scorecard, in output order.
MODEL_FEATURES = [
    "ft_count_xdpd_sum_2m",
    "ft_count_xdpd_max_1m",
    "ft_disbursement_amount_max_2m",
    "ft_disbursement_count_max_3m",
    "ft_count_7dpd_sum_3m",
    "ft_pct_xdpd_change_3m",
    "ft_count_15dpd_sum_3m",
    "ft_count_7dpd_sum_1m",
    "ft_count_xdpd_change_3m",
    "ft_count_xdpd_change_ratio_1m",
]

Spec = Mapping[str, tuple[str, str, int]]


def delinquency_spec() -> dict[str, tuple[str, str, int]]:
    """alias -> (family, column suffix, months) for the 132 delinquency features."""
    spec = {f"ft_has_{c}_{n}m": ("ever", f"count_{c}", n) for n in (1, 2, 3) for c in DPD_CLASSES}
    for value in ("count", "pct"):
        for family in ("max", "change", "min", "sum", "change_ratio"):
            kind = "sum_nullable" if family == "sum" else family
            for n in (1, 2, 3):
                for c in DPD_CLASSES:
                    spec[f"ft_{value}_{c}_{family}_{n}m"] = (kind, f"{value}_{c}", n)
    return spec


def _generic_spec(prefix: str, suffix: str, families: Sequence[str]) -> dict[str, tuple[str, str, int]]:
    short = {"max": "max", "sum": "sum", "change": "chg", "change_ratio": "chg_ratio"}
    return {f"{prefix}_{short[f]}_{n}m": (f, suffix, n) for f in families for n in (1, 2, 3)}


def disbursement_spec() -> dict[str, tuple[str, str, int]]:
    families = ("max", "sum", "change", "change_ratio")
    return {
        **_generic_spec("ft_disbursement_count", "loan_disbursement_count", families),
        **_generic_spec("ft_disbursement_amount", "loan_disbursement_amount", families),
    }


def failed_application_spec() -> dict[str, tuple[str, str, int]]:
    families = ("max", "sum", "change", "change_ratio")
    return {
        **_generic_spec("ft_loanappl_count_fail", "ft_loanappl_count_fail", families),
        **_generic_spec("ft_loanappl_ind_fail", "ft_loanappl_ind_fail", ("max",)),
    }


def month_features(df: DataFrame, anchor: str, months: Sequence[str], spec: Spec, keys: Sequence[str]) -> DataFrame:
    """Keys and the requested look-back features, in the order of ``spec``."""
    return df.select(
        *keys, *[month_feature(family, suffix, n, anchor, months).alias(a) for a, (family, suffix, n) in spec.items()]
    )


def client_months(daily: DataFrame, months: Sequence[str]) -> DataFrame:
    """One row per client with month columns for delinquency and disbursement.

    Columns per month end: ``count_0dpd`` (loans seen), ``count_<class>``, ``pct_<class>``,
    ``loan_disbursement_count`` and ``loan_disbursement_amount``. A month without rows is null.

    The daily table is read and shuffled once for both feature groups: the first aggregate turns
    the days of a loan into one row with the worst day past due of each month, and the two later
    shuffles carry loans and clients only. Days within one task are combined before the shuffle.
    """
    index = range(len(months))
    money = daily.schema["loan_disb"].dataType
    # Position of a month in the list, worked out once per row; null outside of it.
    seen_at = ladder([(F.last_day("pt_date") == lit_date(m), i) for i, m in enumerate(months)])
    rows = daily.select(
        "client_no", "loan_no", "product_type", "tenor", "loan_disb",
        F.last_day("loan_disbursement_date").alias("disb_month"),
        seen_at.alias("at"),
        # An unknown and a non-positive number of days are in no class; null is left to mean "not seen".
        F.greatest(F.coalesce("day_past_due", F.lit(0)), F.lit(0)).alias("dpd"),
    )
    per_terms = rows.groupBy("client_no", "loan_no", "product_type", "tenor", "loan_disb", "disb_month").agg(
        *[F.max(F.when(F.col("at") == i, F.col("dpd"))).alias(f"dpd_{i}") for i in index]
    )
    in_month = [F.col("disb_month") == lit_date(m) for m in months]
    per_loan = per_terms.groupBy("client_no", "loan_no").agg(
        *[F.max(f"dpd_{i}").alias(f"dpd_{i}") for i in index],
        *[F.count_if(in_month[i]).alias(f"terms_{i}") for i in index],
        *[exact_sum(F.when(in_month[i], F.col("loan_disb")), money).alias(f"amount_{i}") for i in index],
    )
    aggs: list[Column] = []
    for i, m in enumerate(months):
        dpd, terms = F.col(f"dpd_{i}"), F.col(f"terms_{i}")
        aggs.append(F.count(dpd).alias(f"_{i}"))
        aggs += [F.count_if(dpd >= low).alias(f"{m}_count_{c}") for c, low in DPD_CLASSES.items()]
        aggs.append(F.sum(terms).alias(f"_terms_{i}"))
        aggs.append(F.sum(F.when(F.col("loan_no").isNotNull(), terms)).alias(f"{m}_loan_disbursement_count"))
        aggs.append(F.sum(f"amount_{i}").cast("double").alias(f"{m}_loan_disbursement_amount"))
    per_client = per_loan.groupBy("client_no").agg(*aggs)
    out = [F.col("client_no")]
    for i, m in enumerate(months):
        loans, terms = F.col(f"_{i}"), F.col(f"_terms_{i}")
        out.append(F.when(loans > 0, loans).alias(f"{m}_count_0dpd"))
        for c in DPD_CLASSES:
            late = F.col(f"`{m}_count_{c}`")
            out.append(F.when(loans > 0, late).alias(f"{m}_count_{c}"))
            out.append(ratio(late, loans).alias(f"{m}_pct_{c}"))
        counted = F.coalesce(F.col(f"`{m}_loan_disbursement_count`"), F.lit(0))
        out.append(F.when(terms > 0, counted).alias(f"{m}_loan_disbursement_count"))
        out.append(F.col(f"`{m}_loan_disbursement_amount`"))
    return per_client.select(*out)


def loan_window(daily: DataFrame, anchor: str, days: int = 130) -> DataFrame:
    return scan_window(daily, "pt_date", anchor, days).where(F.col("prod_type").isin(PRODUCTS))


def loan_features(daily: DataFrame, anchor: str, spec: Spec | None = None, days: int = 130) -> DataFrame:
    """Client features at the anchor month end; all 156 unless ``spec`` asks for fewer."""
    months = month_ends(anchor)
    spec = spec or {**delinquency_spec(), **disbursement_spec()}
    columns = client_months(loan_window(daily, anchor, days), months)
    out = month_features(columns, anchor, months, spec, ["client_no"])
    return out.select("client_no", F.lit(as_date(anchor).isoformat()).alias("pt_date"), *spec)


def months_on_book(at: Column, first: Column) -> Column:
    """Months since the first month, the first one counting as 1."""
    return whole_months_between(at, first) + 1


def segment(dpd: Column) -> Column:
    return F.when(dpd > 0, "xdpd").otherwise("0dpd")


def build_sample(accounts: DataFrame, anchor: str) -> DataFrame:
    """Scored clients at a month end: client_no, pt_date, mob, seg_obs.

    First disbursement month and month-end days past due both come from the rows of the anchor
    day, so one aggregate per client replaces two joins back and a dedup.
    """
    day = as_date(anchor).isoformat()
    if day != month_ends(anchor, 1)[0]:
        raise ValueError(f"{anchor} is no month end")
    rows = accounts.where(
        (F.col("pt_date") == day) & (F.col("repayment_status") != "REFUND") & F.col("sub_prod_code").isin(PRODUCTS)
    )
    per_client = rows.where(F.col("client_no").isNotNull()).groupBy("client_no").agg(
        F.min(F.last_day("disburse_date")).alias("first"), F.max("dpd").alias("dpd")
    )
    return per_client.select(
        "client_no",
        F.lit(day).alias("pt_date"),
        months_on_book(lit_date(anchor), F.col("first")).alias("mob"),
        segment(F.col("dpd")).alias("seg_obs"),
    ).where(F.col("mob") >= 0)


def application_days(apps: DataFrame, anchor: str, days: int = 130) -> DataFrame:
    """Each application version on every day it was valid within the window."""
    lo = F.date_sub(lit_date(anchor), days)
    known = apps.where((F.col("dc_start_date") <= lit_date(anchor)) & (F.col("dc_end_date") > lo))
    first = (as_date(anchor) - dt.timedelta(days=days)).isoformat()
    out = expand_validity(known, "dc_start_date", "dc_end_date", first, anchor, "pt_date")
    return out.select(
        "client_no",
        "loan_no",
        F.to_date(from_epoch_ms(F.col("application_timestamp"))).alias("apply_date"),
        F.col("status").alias("apply_status"),
        "pt_date",
    )


def failed_application_features(apps: DataFrame, anchor: str, days: int = 130, status: str = "LOAN_FAIL") -> DataFrame:
    """Look-back features on failed applications, counted once each in the month of application.

    A version that was valid on several days is one application, so the validity intervals only
    decide whether it falls into the window and need not be expanded.
    """
    months = month_ends(anchor)
    lo, hi = F.date_sub(lit_date(anchor), days), lit_date(anchor)
    start, end = F.greatest("dc_start_date", lo), F.col("dc_end_date")
    failed = (
        apps.where((F.col("status") == status) & (start <= hi) & (start < end))
        .select(
            "client_no", "loan_no", F.last_day(from_epoch_ms(F.col("application_timestamp"))).alias("month")
        )
        .distinct()
    )
    columns = pivot_months(
        failed, ["client_no"], "month", months,
        {"ft_loanappl_count_fail": ("count", F.lit(1)), "ft_loanappl_ind_fail": ("max", F.lit(1))},
    )
    out = month_features(columns, anchor, months, failed_application_spec(), ["client_no"])
    return out.withColumn("pt_date", F.lit(as_date(anchor).isoformat()))
