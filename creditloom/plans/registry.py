"""Named feature jobs with one driver that adds the partition column and writes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.plans.apps import app_features
from creditloom.plans.devices import device_features
from creditloom.plans.job_health import job_health_labels
from creditloom.plans.loans import failed_application_features, loan_features
from creditloom.plans.scoring import loan_score
from creditloom.sources.sinks import insert_aligned, replace_partition

# Builders take (tables by name, anchor date, parameters). They run only when asked for.
REGISTRY: dict[str, Callable[[Mapping[str, DataFrame], str, Mapping], DataFrame]] = {
    "ft_device": lambda t, anchor, p: device_features(t["device_raw"], t["price"], anchor, **p),
    "ft_device_user_level": lambda t, anchor, p: device_features(
        t["device_raw"], t["price"], anchor, key="client_no", actions=t["action_log"], population=t.get("population"), **p
    ),
    "ft_app_device_level": lambda t, anchor, p: app_features(t["app_log"], anchor, **p),
    "ft_loan_status": lambda t, anchor, p: loan_features(t["loan_daily"], anchor, **p),
    "ft_failed_application": lambda t, anchor, p: failed_application_features(t["application_scd2"], anchor, **p),
    "loan_score": lambda t, anchor, p: loan_score(t["loan_daily"], t["accounts"], anchor, **p),
    "job_health": lambda t, anchor, p: job_health_labels(t["job_run"], anchor, **p),
}


def build(name: str, tables: Mapping[str, DataFrame], anchor: str, params: Mapping | None = None) -> DataFrame:
    """Features of one registered job with its ``pt_date``."""
    if name not in REGISTRY:
        raise KeyError(f"unknown feature job {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name](tables, anchor, params or {}).withColumn("pt_date", F.lit(anchor))


def run(
    name: str, tables: Mapping[str, DataFrame], anchor: str, table: str,
    params: Mapping | None = None, path: str | None = None,
) -> None:
    """Build and write the anchor's partition, the only action.

    An existing table has that partition replaced, by name, and emptied where the job yields no
    rows; its other partitions stay. Data that lacks a column of the table is refused.
    """
    rows = build(name, tables, anchor, params)
    if rows.sparkSession.catalog.tableExists(table):
        replace_partition(rows, table, {"pt_date": anchor})
    else:
        insert_aligned(rows, table, ["pt_date"], path)
