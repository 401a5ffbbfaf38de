"""Edges of the job labels, one job per case."""

import datetime as dt

import pytest

from creditloom.plans.job_health import job_health_labels

COLUMNS = (
    "pt_date string, job_id string, user_id string, user_name string, team_id string, team_name string, app_name string,"
    " task_table_name string, app_queue string, app_type string, final_state string, attempt_number int,"
    " airflow_try_number int, avg_memory_allocate_gb double, input_size_gb double, gb_max_shuffle_read_size double,"
    " gb_avg_shuffle_read_size double, gb_max_shuffle_write_size double, gb_avg_shuffle_write_size double,"
    " major_gc_time double, task_time double, spill_disk_gb double, elapsed_time_min double, queue_wait_time double,"
    " memory_gb_hour double, started_date timestamp"
)
NAMES = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]


def job(job_id, day="2024-05-07", at="10:00:00", **values):
    row = {**dict.fromkeys(NAMES), "pt_date": day, "job_id": job_id, **values}
    row.setdefault("started_date", None)
    row["started_date"] = values.get("started_date") or dt.datetime.fromisoformat(f"{day}T{at}")
    return tuple(row[n] for n in NAMES)


@pytest.fixture(scope="module")
def labels(spark):
    days = [f"2024-05-0{i}" for i in range(1, 8)]
    data = [
        job("plain"),
        job("fail", final_state="FAILED"),
        job("retry", app_type="Spark", attempt_number=1, airflow_try_number=4),
        job("retry_no_spark", app_type="hive", attempt_number=9, airflow_try_number=9),
        job("slow", elapsed_time_min=60.5, queue_wait_time=10.5),
        job("little_memory", avg_memory_allocate_gb=1.0, input_size_gb=2.0),
        job("some_memory", avg_memory_allocate_gb=2.0, input_size_gb=1.0),
        job("much_memory", avg_memory_allocate_gb=3.0, input_size_gb=1.0),
        job("skew", gb_max_shuffle_read_size=3.5, gb_avg_shuffle_read_size=1.0, gb_max_shuffle_write_size=9.0, gb_avg_shuffle_write_size=0.0),
        job("gc", major_gc_time=0.3, task_time=1.0),
        job("spill", spill_disk_gb=0.1),
        job("twice", at="08:00:00", final_state="FAILED"),
        job("twice", at="09:00:00", final_state="OK"),
        job("other_day", started_date=dt.datetime(2024, 5, 6, 1)),
        job("late", at="23:30:00"),
    ]
    for day in days:
        data.append(job(f"big{day}", day, task_table_name="big", memory_gb_hour=100.0, elapsed_time_min=1.0, app_queue="x.P0"))
        data.append(job(f"null{day}", day, memory_gb_hour=90.0))
        if day != "2024-05-03":
            data.append(job(f"gap{day}", day, task_table_name="gap", memory_gb_hour=95.0))
    runs = spark.createDataFrame(data, COLUMNS)
    out = {strict: {r["job_id"]: r for r in job_health_labels(runs, "2024-05-07", 7, (3, 1), strict).collect()} for strict in (False, True)}
    return out


def test_rows(labels):
    ids = set(labels[False])
    assert "other_day" not in ids and "big2024-05-06" not in ids and {"plain", "twice", "gap2024-05-07"} <= ids


def test_single_labels(labels):
    l = labels[False]
    assert l["fail"]["task_failed_label"] == 1 and l["twice"]["task_failed_label"] == 0
    assert (l["retry"]["spark_stage_failed_label"], l["retry"]["spark_stage_failed_gt3_label"]) == (1, 0)
    assert (l["retry"]["spark_task_retry_label"], l["retry"]["spark_task_retry_gt3_label"]) == (1, 1)
    assert l["retry_no_spark"]["spark_stage_failed_label"] == 0 and l["retry_no_spark"]["task_type_label"] == "Hive"
    assert (l["slow"]["runtime_gt_1h_label"], l["slow"]["submit_wait_gt_10min_label"]) == (1, 1)
    assert (l["skew"]["data_skew_read_label"], l["skew"]["data_skew_write_label"]) == (1, 0)
    assert l["gc"]["full_gc_label"] == 1 and l["spill"]["spill_disk_label"] == 1
    assert l["late"]["started_hour_bucket"] == "[23, 24)"


def test_memory_and_health(labels):

    l, strict = labels[False], labels[True]
    assert l["little_memory"]["memory_alloc_insufficient_label"] == 1 and l["little_memory"]["task_health_label"] == 1
    assert l["some_memory"]["memory_waste_label"] == 0 and l["some_memory"]["task_health_label"] == 0
    assert l["much_memory"]["memory_waste_label"] == 1 and l["much_memory"]["task_health_label"] == 0
    assert strict["little_memory"]["task_health_label"] == 0 and strict["some_memory"]["task_health_label"] == 1
    assert l["plain"]["task_health_label"] == 1 and l["slow"]["task_health_label"] == 1
    for sick in ("fail", "retry", "skew", "gc", "spill"):
        assert l[sick]["task_health_label"] == 0


def test_streaks(labels):
    l = labels[False]
    big, gap, nameless = l["big2024-05-07"], l["gap2024-05-07"], l["null2024-05-07"]
    assert (big["mu_top3_label"], big["mu_top1_label"], big["p0_p1_runtime_top1_label"]) == (1, 1, 1)
    assert (gap["mu_top3_label"], nameless["mu_top3_label"]) == (0, 0)
    assert big["task_health_label"] == 0


def test_label_values_are_complete(labels):
    assert all(v is not None for r in labels[False].values() for k, v in r.asDict().items() if k.endswith("_label"))


def test_only_contenders_are_sorted_and_none_is_lost(spark):
    """Jobs with ties, later attempts that are smaller, and no id: the first k are those of all jobs, found among few."""
    from pyspark.sql import functions as F

    from creditloom.operators.windows import top_ranked
    from creditloom.plans.job_health import _ranked, job_window, top_contenders

    columns = {c.strip().split(" ")[0]: c.strip().split(" ")[1] for c in COLUMNS.split(",")}
    n = F.col("id")
    own = {
        "pt_date": F.concat(F.lit("2024-05-0"), n % 2 + 6),
        "job_id": F.when(n % 997 != 0, F.concat(F.lit("j"), F.floor(n / 6))),
        "task_table_name": F.concat(F.lit("t"), n % 50),
        "app_queue": F.when(n % 3 == 0, "p0"),
        "memory_gb_hour": F.when(n % 7 != 0, (n * 7919 % 1000).cast("double")),
        "elapsed_time_min": (n % 2).cast("double"),
        "started_date": F.to_timestamp(F.concat(F.lit("2024-05-0"), n % 2 + 6, F.lit(" 0"), F.floor(n / 2) % 2, F.lit(":00:00"))),
    }
    runs = spark.range(24_000).select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    latest, found = job_window(runs, "2024-05-07", 2), top_contenders(runs, "2024-05-07", 2, 5)

    def first(jobs):
        return sorted(map(tuple, top_ranked(jobs, "pt_date", ["task_table_name"], _ranked(), 5, "job_id").collect()), key=repr)

    assert first(found) == first(latest) and len(first(found)) == 40
    assert latest.count() > 7_900 and found.count() < 1_500
