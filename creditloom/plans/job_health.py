"""Health labels for cluster jobs from a job-run table (one row per attempt and day)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.columns import classify, flag
from creditloom.functions.dates import as_date, hour_bucket
from creditloom.operators.aggregates import streak
from creditloom.operators.windows import dedup, queue_class, top_ranked

# Job types by the words found in type or name, first match wins.
JOB_TYPES = [("Spark", ["spark"]), ("Hive", ["hive"]), ("Flink", ["flink"]), ("DataX", ["datax"])]

# Marks of priority queues.
PRIORITY_MARKS = ["p0", "p1"]

# Columns that the label table keeps from the job run, in output order.
JOB_COLUMNS = ["job_id", "user_id", "user_name", "team_id", "team_name", "app_name", "app_queue", "app_type"]


def _value(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _is_spark() -> Column:
    return classify([F.col("app_type"), F.col("app_name")], JOB_TYPES[:1], "") == "Spark"


def _skewed(largest: str, average: str) -> Column:
    mean = F.col(average)
    return (mean > 0) & (F.try_divide(F.col(largest) - mean, mean) > 2)


def _gc_heavy() -> Column:
    return (F.col("task_time") > 0) & (F.try_divide(F.col("major_gc_time"), F.col("task_time")) > 0.2)


def row_labels() -> dict[str, Column]:
    """Labels that depend on the job's own row only."""
    memory, size = F.col("avg_memory_allocate_gb"), F.col("input_size_gb")
    return {
        "task_failed_label": flag(F.lower("final_state") == "failed"),
        "spark_stage_failed_label": flag(_is_spark() & (_value("attempt_number") > 0)),
        "spark_stage_failed_gt3_label": flag(_is_spark() & (_value("attempt_number") > 3)),
        "spark_task_retry_label": flag(_is_spark() & (_value("airflow_try_number") > 0)),
        "spark_task_retry_gt3_label": flag(_is_spark() & (_value("airflow_try_number") > 3)),
        "runtime_gt_1h_label": flag(F.col("elapsed_time_min") > 60),
        "submit_wait_gt_10min_label": flag(F.col("queue_wait_time") > 10),
        "memory_alloc_insufficient_label": flag(memory < size),
        "memory_waste_label": flag(memory > size * 2.5),
        "data_skew_read_label": flag(_skewed("gb_max_shuffle_read_size", "gb_avg_shuffle_read_size")),
        "data_skew_write_label": flag(_skewed("gb_max_shuffle_write_size", "gb_avg_shuffle_write_size")),
        "full_gc_label": flag(_gc_heavy()),
        "spill_disk_label": flag(F.col("spill_disk_gb") > 0),
    }


def task_type() -> Column:
    return classify([F.col("app_type"), F.col("app_name")], JOB_TYPES, "Other")


# The jobs of one digest in so many give the bound below which no job is ranked.
BOUND_SHARE = 16

# Metric name -> (column, rows that take part: None for all, else the priority class).
STREAK_METRICS: dict[str, tuple[str, int | None]] = {
    "mu": ("memory_gb_hour", None),
    "runtime": ("elapsed_time_min", None),
    "p0_p1_runtime": ("elapsed_time_min", 1),
    "non_p0_p1_runtime": ("elapsed_time_min", 0),
}


def streak_names(ks: Sequence[int]) -> list[str]:
    return [f"{m}_top{k}_label" for m in STREAK_METRICS for k in ks]


def _inside(runs: DataFrame, asof: str, days: int) -> DataFrame:
    """Runs of the window; runs that started on another day are left out."""
    first = (as_date(asof) - dt.timedelta(days=days - 1)).isoformat()
    return runs.where(
        (F.col("pt_date") >= first)
        & (F.col("pt_date") <= asof)
        & (F.to_date("started_date") == F.col("pt_date").cast("date"))
    )


def _latest(runs: DataFrame, digest: Column) -> DataFrame:
    """Latest attempt of each job and day; a digest of the row decides among attempts of one time."""
    return dedup(runs, ["pt_date", "job_id"], [F.col("started_date").desc(), digest])


def job_window(runs: DataFrame, asof: str, days: int) -> DataFrame:
    """Latest attempt of each job and day in the window; runs that started on another day are left out."""
    return _latest(_inside(runs, asof, days), F.xxhash64(*runs.columns))


def _ranked() -> dict[str, tuple[str, Column | None]]:
    priority = queue_class(F.col("app_queue"), PRIORITY_MARKS)
    return {name: (col, None if wanted is None else priority == wanted) for name, (col, wanted) in STREAK_METRICS.items()}


def _daily_bounds(runs: DataFrame, k: int) -> DataFrame:
    """Per day and metric a place that at least ``k`` jobs reach: the k-th among the jobs of one digest in ``BOUND_SHARE``.

    A day without so many of these jobs has null for the metric, which every job reaches.
    """
    some = runs.where(F.pmod(F.xxhash64("job_id"), F.lit(BOUND_SHARE)) == 0)
    latest = _latest(some, F.col("_digest"))
    top = top_ranked(latest, "pt_date", sorted({col for col, _ in STREAK_METRICS.values()}), _ranked(), k, "job_id")
    last = top.where(F.col("rank") == k)
    values = {m: F.struct(F.coalesce(F.col(col), F.lit(0)).alias("value"), "job_id") for m, (col, _) in STREAK_METRICS.items()}
    return last.groupBy(F.col("pt_date").alias("_day")).agg(
        *[F.max(F.when(F.col("metric") == m, v)).alias(f"_{m}") for m, v in values.items()]
    )


def top_contenders(runs: DataFrame, asof: str, days: int, k: int) -> DataFrame:
    """Latest attempts of the window's jobs that may be among the first ``k`` of a day and metric.

    All of the first k are there, so ranks up to k are those among all jobs. A job of which no
    attempt reaches ``_daily_bounds`` has k better ones. All attempts of the others are kept until
    the latest is known, so an earlier attempt never stands in for it. Runs are filtered and not
    sorted: a sort would hold a task's whole share of the table.
    """
    columns = ["pt_date", "job_id", "task_table_name", "app_queue", *sorted({col for col, _ in STREAK_METRICS.values()})]
    narrow = _inside(runs, asof, days).select(*columns, "started_date", F.xxhash64(*runs.columns).alias("_digest"))

    def reaches(metric: str, col: str, condition: Column | None) -> Column:
        value, bound = F.coalesce(F.col(col), F.lit(0)), F.col(f"_{metric}")
        as_good = (value > bound["value"]) | ((value == bound["value"]) & (F.col("job_id") <= bound["job_id"]))
        counts = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        return counts & F.coalesce(as_good, F.lit(True))

    # One row a day of the window.
    bounded = narrow.join(F.broadcast(_daily_bounds(narrow, k)), F.col("pt_date") == F.col("_day"), "left")
    found = bounded.where(reduce(Column.__or__, [reaches(m, *of) for m, of in _ranked().items()]))
    jobs = found.select(F.col("pt_date").alias("_at"), F.col("job_id").alias("_job")).distinct()
    same = F.col("pt_date").eqNullSafe(F.col("_at")) & F.col("job_id").eqNullSafe(F.col("_job"))
    return _latest(narrow.join(jobs, same).drop("_at", "_job"), F.col("_digest"))


def top_streaks(jobs: DataFrame, days: int, ks: Sequence[int]) -> DataFrame:
    """Per task name, 1 where it was among the daily top k on every day of the window.

    Only the top rows of each day are looked at: a name that is on top on all days was present on
    all days, so absent names need no row. The result has at most max(ks) names per metric.
    """
    top = top_ranked(jobs, "pt_date", ["task_table_name"], _ranked(), max(ks), "job_id")
    flags = {
        f"{m}_top{k}_label": flag((F.col("metric") == m) & (F.col("rank") <= k)) for m in STREAK_METRICS for k in ks
    }
    daily = top.where(F.col("task_table_name").isNotNull()).withColumns(flags)
    marked = streak(daily, "task_table_name", "pt_date", list(flags), days)
    return marked.where(reduce(Column.__or__, [F.col(f) == 1 for f in flags]))


def job_health_labels(
    runs: DataFrame, asof: str, days: int = 7, ks: Sequence[int] = (100, 50), strict: bool = False
) -> DataFrame:
    """One row per job of the day ``asof`` with all labels.

    ``task_health_label`` is 1 when no failure, retry, streak, skew, GC or spill label is set and
    memory does not exceed the input. The latter is the rule as it is used: it calls every
    over-allocated job unhealthy and ignores too little memory. ``strict=True`` uses the two
    memory labels instead.
    """
    streaks = top_streaks(top_contenders(runs, asof, days, max(ks)), days, ks)
    today = job_window(runs.where(F.col("pt_date") == asof), asof, 1)
    names = streak_names(ks)
    # A streak needs a top place on every day, so this side has at most max(ks) rows per metric.
    joined = today.join(F.broadcast(streaks), "task_table_name", "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)) for n in names}
    )
    own = row_labels()
    ignored = {"runtime_gt_1h_label", "submit_wait_gt_10min_label"}
    if not strict:
        ignored |= {"memory_alloc_insufficient_label", "memory_waste_label"}
    against = [F.col(n) == 1 for n in [*names, *[n for n in own if n not in ignored]]]
    if not strict:
        against.append(F.coalesce(F.col("avg_memory_allocate_gb") > F.col("input_size_gb"), F.lit(False)))
    failure_first = [n for n in own if n.startswith(("task_", "spark_"))]
    rest = [n for n in own if n not in failure_first]
    return (
        joined.withColumns(own)
        .withColumn("task_type_label", task_type())
        .withColumn("task_health_label", F.when(reduce(Column.__or__, against), 0).otherwise(1))
        .withColumn("started_hour_bucket", hour_bucket(F.col("started_date")))
        .select(
            *JOB_COLUMNS, "task_type_label", *failure_first, *names, *rest, "task_health_label", "started_hour_bucket"
        )
    )
