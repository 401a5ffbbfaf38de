"""LB* queries: one per label, and the whole label table."""

from pyspark.sql import functions as F

from creditloom.plans.job_health import job_health_labels
from workload.base import query
from workload.standins import JOB_DAY, job_copies, job_run

KS = (40, 25)
#: The daily places that the labels are defined by; they need more jobs a day than ``job_run`` has.
DEFINED_KS = (100, 50)

_STREAK = {
    "mu": ("memory_gb_hour", "TRUE"),
    "runtime": ("elapsed_time_min", "TRUE"),
    "p0_p1_runtime": ("elapsed_time_min", "q = 1"),
    "non_p0_p1_runtime": ("elapsed_time_min", "q = 0"),
}


def _rank(metric, condition):
    group = "pt_date" if condition == "TRUE" else "pt_date, q"
    return f"row_number() OVER (PARTITION BY {group} ORDER BY coalesce({metric}, 0) DESC, job_id)"


_RANKS = ", ".join(f"CASE WHEN {cond} THEN {_rank(metric, cond)} END AS r_{name}" for name, (metric, cond) in _STREAK.items())


def _base(ks, runs):
    days = ", ".join(f"count(DISTINCT pt_date) FILTER (r_{name} <= {k}) AS d_{name}_{k}" for name in _STREAK for k in ks)
    tops = ", ".join(
        f"CASE WHEN coalesce(d_{name}_{k}, 0) = 7 THEN 1 ELSE 0 END AS {name}_top{k}_label" for name in _STREAK for k in ks
    )
    return f"""
wk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pt_date, job_id ORDER BY started_date DESC) AS r0
    FROM {runs} WHERE pt_date BETWEEN '2024-01-22' AND '{JOB_DAY}' AND started_date::DATE = CAST(pt_date AS DATE)) WHERE r0 = 1),
wq AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(app_queue, '')), 'p0|p1') THEN 1 ELSE 0 END AS q FROM wk),
wr AS (SELECT *, {_RANKS} FROM wq),
nd AS (SELECT task_table_name, {days} FROM wr WHERE task_table_name IS NOT NULL GROUP BY 1),
td AS (SELECT wr.*, nd.* EXCLUDE (task_table_name), coalesce(app_type, '') || '/' || coalesce(app_name, '') AS what
    FROM wr LEFT JOIN nd ON nd.task_table_name = wr.task_table_name WHERE pt_date = '{JOB_DAY}'),
lb AS (SELECT job_id, user_id, user_name, team_id, team_name, app_name, app_queue, app_type,
  CASE WHEN what ILIKE '%spark%' THEN 'Spark' WHEN what ILIKE '%hive%' THEN 'Hive' WHEN what ILIKE '%flink%' THEN 'Flink'
    WHEN what ILIKE '%datax%' THEN 'DataX' ELSE 'Other' END AS task_type_label,
  CASE WHEN final_state ILIKE 'failed' THEN 1 ELSE 0 END AS task_failed_label,
  CASE WHEN what ILIKE '%spark%' AND attempt_number > 0 THEN 1 ELSE 0 END AS spark_stage_failed_label,
  CASE WHEN what ILIKE '%spark%' AND attempt_number > 3 THEN 1 ELSE 0 END AS spark_stage_failed_gt3_label,
  CASE WHEN what ILIKE '%spark%' AND airflow_try_number > 0 THEN 1 ELSE 0 END AS spark_task_retry_label,
  CASE WHEN what ILIKE '%spark%' AND airflow_try_number > 3 THEN 1 ELSE 0 END AS spark_task_retry_gt3_label,
  {tops},
  CASE WHEN elapsed_time_min > 60 THEN 1 ELSE 0 END AS runtime_gt_1h_label,
  CASE WHEN queue_wait_time > 10 THEN 1 ELSE 0 END AS submit_wait_gt_10min_label,
  CASE WHEN avg_memory_allocate_gb < input_size_gb THEN 1 ELSE 0 END AS memory_alloc_insufficient_label,
  CASE WHEN avg_memory_allocate_gb > input_size_gb * 2.5::DOUBLE THEN 1 ELSE 0 END AS memory_waste_label,
  CASE WHEN gb_avg_shuffle_read_size > 0
    AND (gb_max_shuffle_read_size - gb_avg_shuffle_read_size) / gb_avg_shuffle_read_size > 2 THEN 1 ELSE 0 END
    AS data_skew_read_label,
  CASE WHEN gb_avg_shuffle_write_size > 0
    AND (gb_max_shuffle_write_size - gb_avg_shuffle_write_size) / gb_avg_shuffle_write_size > 2 THEN 1 ELSE 0 END
    AS data_skew_write_label,
  CASE WHEN task_time > 0 AND major_gc_time / task_time > 0.2::DOUBLE THEN 1 ELSE 0 END AS full_gc_label,
  CASE WHEN spill_disk_gb > 0 THEN 1 ELSE 0 END AS spill_disk_label,
  CASE WHEN avg_memory_allocate_gb > input_size_gb THEN 1 ELSE 0 END AS over_allocated,
  '[' || hour(started_date) || ', ' || (hour(started_date) + 1) || ')' AS started_hour_bucket FROM td)"""


BASE = _base(KS, "job_run")

_ALWAYS = ["task_failed_label", "spark_stage_failed_label", "spark_task_retry_label", "data_skew_read_label",
           "data_skew_write_label", "full_gc_label", "spill_disk_label"] + [f"{n}_top{k}_label" for n in _STREAK for k in KS]


def _healthy(extra):
    return f"CASE WHEN {' + '.join(_ALWAYS + extra)} = 0 THEN 1 ELSE 0 END AS task_health_label"


def labels(spark, d, strict=False):
    return job_health_labels(job_run(spark, d), JOB_DAY, 7, KS, strict)


@query("lb_job_health_labels", f"WITH {BASE} SELECT * EXCLUDE (over_allocated), {_healthy(['over_allocated'])} FROM lb", ["job_run"])
def lb_all(spark, d):
    return labels(spark, d)


NUMBERED = {
    1: ("task_type", "task_type_label"),
    2: ("task_failed", "task_failed_label"),
    3: ("spark_stage_failed", "spark_stage_failed_label"),
    4: ("spark_stage_failed_gt3", "spark_stage_failed_gt3_label"),
    5: ("spark_task_retry", "spark_task_retry_label"),
    6: ("spark_task_retry_gt3", "spark_task_retry_gt3_label"),
    15: ("runtime_gt_1h", "runtime_gt_1h_label"),
    16: ("submit_wait_gt_10min", "submit_wait_gt_10min_label"),
    17: ("memory_alloc_insufficient", "memory_alloc_insufficient_label"),
    18: ("memory_waste", "memory_waste_label"),
    19: ("data_skew_read", "data_skew_read_label"),
    20: ("data_skew_write", "data_skew_write_label"),
    21: ("full_gc", "full_gc_label"),
    22: ("spill_disk", "spill_disk_label"),
    24: ("started_hour_bucket", "started_hour_bucket"),
}


def _register(number, word, label):
    @query(f"lb{number}_{word}", f"WITH {BASE} SELECT job_id, {label} FROM lb", ["job_run"])
    def run(spark, d):
        return labels(spark, d).select("job_id", label)


for _number, (_word, _label) in NUMBERED.items():
    _register(_number, _word, _label)


def _register_top(number, word, label):
    @query(f"lb{number}_{word}", f"WITH {_base(DEFINED_KS, 'job_copies')} SELECT job_id, {label} FROM lb", ["job_copies"])
    def run(spark, d):
        return job_health_labels(job_copies(spark, d), JOB_DAY, 7, DEFINED_KS).select("job_id", label)


for _place, _metric in enumerate(_STREAK):
    for _offset, (_width, _k) in enumerate(zip(("wide", "narrow"), DEFINED_KS)):
        _register_top(7 + 2 * _place + _offset, f"{_metric}_top_{_width}", f"{_metric}_top{_k}_label")


@query("lb23_task_health", f"WITH {BASE} SELECT job_id, {_healthy(['over_allocated'])} FROM lb", ["job_run"])
def lb23(spark, d):
    return labels(spark, d).select("job_id", "task_health_label")


@query("lb23_task_health_strict", f"""WITH {BASE} SELECT job_id,
  {_healthy(['memory_alloc_insufficient_label', 'memory_waste_label'])} FROM lb""", ["job_run"])
def lb23_strict(spark, d):
    return labels(spark, d, strict=True).select("job_id", "task_health_label")


@query("lb_labels_by_type", f"""WITH {BASE} SELECT task_type_label, count(*) AS jobs, CAST(sum(spill_disk_label) AS BIGINT) AS spilled,
  CAST(sum(task_failed_label) AS BIGINT) AS failed FROM lb GROUP BY 1""", ["job_run"])
def lb_by_type(spark, d):
    return labels(spark, d).groupBy("task_type_label").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("spill_disk_label").alias("spilled"), F.sum("task_failed_label").alias("failed")
    )
