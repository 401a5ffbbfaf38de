"""Captured pages: text as a browser copies it."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from creditloom.operators import captures as C
from creditloom.operators import evidence as E
from creditloom.sources.footers import file_footers
from creditloom.sources.scans import read_pages

NAV = " 3.2.1\nJobs\nStages\nStorage\nEnvironment\nExecutors\nSQL\nnightly_score application UI\n"

STAGES = NAV + (
    "Stages for All Jobs\nCompleted Stages: 4\n1 Pages. Jump to\n1\n. Show\n100\nitems in a page.\nPage:\n1\nStage Id\nDescription\n"
    "Submitted\nDuration\nTasks: Succeeded/Total\t\nInput\nOutput\nShuffle Read\nShuffle Write\n"
    "65\t\nsave at X.java:0+details\n2026/06/05 10:50:36\t27 min\t\n11251/11251 (116 failed)\n739.2 GiB\t\t\t1314.0 GiB\n"
    "47\t\ncount at X.java:0+details\n2026/06/05 10:31:35\t19 min\t\n200/200\n1760.5 GiB\t11.5 KiB\n"
    "5\t\nbroadcast exchange (runId ca33)\n$anonfun at F.java:266+details\n2026/06/04 10:30:36\tUnknown\t\n0/1\n"
    "2\t\ninsert at X.java:0+details\n2026/06/04 05:10:00\t5 s\t\n4/4\n4.9 KiB\n"
    "0\t\nListing leaf files and directories for 360 paths:\nhdfs://a/pt_date=2025-06-09, ...\ninsert at X.java:0+details\n"
    "Unknown\tUnknown\t\n360/360 (8 killed: another attempt succeeded)(1 killed: Finish)(1 killed: Stage finished)\n"
    "1 Pages. Jump to\n1\n. Show\n"
)
JOBS = NAV + (
    "Spark Jobs (?)\nUser: x\nTotal Uptime: 4.5 h\nJob Id (Job Group)\nDescription\nStages: Succeeded/Total\tTasks (for all stages): Succeeded/Total\n"
    "35\t\nsave at X.java:0\nsave at X.java:0\t2026/06/05 11:34:09\t2.3 h\t1/2 (1 skipped)\t\n200/200 (80 failed) (11251 skipped)\n"
    "24 (bf79-4be9)\t\nbroadcast exchange (runId bf79)\n$anonfun at F.java:266\t2026/06/05 10:50:35\t9 s\t1/1\t\n1/1\n"
)
EXECUTORS = NAV + (
    "Executors\nShow Additional Metrics\nSummary\nRDD Blocks\tStorage Memory\tDisk Used\tCores\tActive Tasks\tFailed Tasks\n"
    "Active(10)\t0\t0.0 B / 82 GiB\t0.0 B\t36\t0\t0\t12623\t12623\t111.9 h (16 min)\t401.1 GiB\t2.2 TiB\t592.2 GiB\t0\n"
    "Dead(64)\t0\t0.0 B / 552.9 GiB\t0.0 B\t256\t5\t251\t41504\t41760\t164.3 h (45 min)\t1.3 TiB\t2.8 TiB\t1.8 TiB\t0\n"
    "Total(74)\t0\t0.0 B / 634.9 GiB\t0.0 B\t292\t5\t251\t54127\t54383\t276.2 h (1.0 h)\t1.7 TiB\t5 TiB\t2.4 TiB\t0\nExecutors\nShow\n"
    "driver\thost-a.dc:37883\tActive\t0\t0.0 B / 4.2 GiB\t0.0 B\t0\t0\t0\t0\t0\t0.0 ms (0.0 ms)\t0.0 B\t0.0 B\t0.0 B\t\nstdout\nstderr\n"
    "7\thost-b.dc:42551\tDead\t0\t0.0 B / 8.6 GiB\t0.0 B\t4\t0\t4\t1982\t1986\t9.2 h (2.0 min)\t69.3 GiB\t160.1 GiB\t102.5 GiB\t\nstdout\n"
)
DETAIL = NAV + (
    "Details for Stage 65 (Attempt 2)\nSummary Metrics for 11251 Completed Tasks\nMetric\tMin\t25th percentile\tMedian\t75th percentile\tMax\n"
    "Duration\t0.8 s\t9 s\t10 s\t12 s\t42 s\nGC Time\t0.0 ms\t49.0 ms\t66.0 ms\t93.0 ms\t1 s\n"
    "Input Size / Records\t192 KiB / 0\t59.3 MiB / 22\t63.5 MiB / 23\t87.6 MiB / 32\t88.9 MiB / 33\nTasks (11367)\n"
    "Index\tTask ID\tAttempt\tStatus\tLocality level\tExecutor ID\tHost\tLogs\tLaunch Time\tDuration\tGC Time\tInput Size / Records\tErrors\n"
    "0\t40564\t0\tSUCCESS\tNODE_LOCAL\t21\thost-a.dc\t\nstdout\nstderr\n2026-06-05 11:09:45\t13 s\t0.3 s\t88.5 MiB / 3297280\t\n"
    "1\t40541\t1\tFAILED\tANY\t4\thost-b.dc\t\nstdout\nstderr\n2026-06-05 11:09:43\t16 s\t\t\tlost\n"
)
SETTINGS = NAV + "Environment\n Spark Properties\nName\tValue\nspark.executor.cores\t4\nspark.sql.shuffle.partitions\t200\nspark.driver.extra\t\n"


@pytest.fixture(scope="module")
def pages(spark):
    texts = {"executors.txt": STAGES, "stages.txt": JOBS, "sql.txt": EXECUTORS, "stage_116_detail.txt": DETAIL, "jobs.txt": SETTINGS,
             "yarn.txt": "Logged in\nApplication Overview\nUser: x\n"}
    return spark.createDataFrame([("one", f"/c/one/{n}", t) for n, t in texts.items()], "case string, path string, text string").cache()


def test_kind_comes_from_the_content(pages):
    got = {r["file_name"]: (r["page_kind"], r["app_name"]) for r in C.capture_manifest(pages).collect()}
    assert got["executors.txt"] == ("stages", "nightly_score") and got["stages.txt"][0] == "jobs" and got["sql.txt"][0] == "executors"
    assert got["jobs.txt"][0] == "environment" and got["yarn.txt"] == ("cluster_application", None)
    detail = C.classify_pages(pages).where("page_kind = 'stage_detail'").first()
    assert (detail["stage_id"], detail["attempt"]) == (65, 2)


def test_stage_rows(pages):
    got = {r["stage_id"]: r for r in C.stage_rows(pages).collect()}
    assert set(got) == {65, 47, 5, 2, 0}
    big = got[65]
    assert (big["tasks_done"], big["failed"], big["duration_s"], big["sizes_known"]) == (11251, 116, 1620.0, True)
    assert big["shuffle_write_bytes"] == 1314.0 * 1024**3 and big["output_bytes"] is None
    assert got[47]["sizes_known"] is False and got[47]["input_bytes"] is None and got[47]["sizes_text"] == "1760.5 GiB\t11.5 KiB"
    assert got[5]["action"] == "$anonfun at F.java:266" and got[5]["duration_s"] is None and got[5]["tasks_total"] == 1
    assert got[0]["killed"] == 10 and got[0]["submitted"] is None and got[0]["action"] == "insert at X.java:0"


def test_job_rows(pages):
    got = {r["job_id"]: r for r in C.job_rows(pages).collect()}
    assert (got[35]["failed"], got[35]["tasks_skipped"], got[35]["stages_total"], got[35]["duration_s"]) == (80, 11251, 2, 8280.0)
    assert (got[24]["action"], got[24]["tasks_total"]) == ("$anonfun at F.java:266", 1)


def test_executor_summary(pages):
    got = C.executor_summary(C.executor_totals(pages)).first()
    assert (got["active"], got["dead"], got["total"], got["cores"]) == (10, 64, 74, 292)
    assert (got["failed_tasks"], got["complete_tasks"], got["total_tasks"]) == (251, 54127, 54383)
    assert got["gc_time_s"] == 3600.0


def test_rows_of_executors_and_tasks(pages):
    got = {r["executor_id"]: r for r in C.executor_rows(pages).collect()}
    assert set(got) == {"driver", "7"} and got["driver"]["state"] == "active"
    assert (got["7"]["host"], got["7"]["state"], got["7"]["failed_tasks"], got["7"]["total_tasks"]) == ("host-b.dc", "dead", 4, 1986)
    assert (got["7"]["gc_time_s"], got["7"]["shuffle_write_bytes"]) == (120.0, 102.5 * 1024**3)
    tasks = {r["task_id"]: r for r in C.task_rows(pages).collect()}
    assert set(tasks) == {40564, 40541}
    first, second = tasks[40564], tasks[40541]
    assert (first["stage_id"], first["stage_attempt"], first["duration_s"], first["gc_time_s"]) == (65, 2, 13.0, 0.3)
    assert (first["input_bytes"], first["input_records"], first["shuffle_read_bytes"]) == (88.5 * 1024**2, 3297280, None)
    assert (second["status"], second["attempt"], second["host"], second["gc_time_s"], second["input_bytes"]) == ("FAILED", 1, "host-b.dc", None, None)


def test_very_long_entries(spark):
    """A description of 50,000 lines is one entry; no expression recurses over lines."""
    text = "x\n" * 50_000
    stage = NAV + "Stages for All Jobs\n7\t\n" + text + "save at X.java:0+details\n2026/06/05 11:34:09\t2 s\t\n3/4\n"
    job = NAV + "Spark Jobs (?)\n8\t\n" + text + "save at X\t2026/06/05 11:34:09\t2 s\t1/1\t\n5/6\n"
    more = spark.createDataFrame([("c", "s", stage), ("c", "j", job)], "case string, path string, text string")
    assert rows(C.stage_rows(more).select("stage_id", "tasks_done", "duration_s", "action")) == [(7, 3, 2.0, "save at X.java:0")]
    assert rows(C.job_rows(more).select("job_id", "tasks_done", "action")) == [(8, 5, "save at X")]


def test_stage_summary(pages):
    got = {r["metric"]: r for r in C.stage_summary(pages).collect()}
    assert set(got) == {"Duration", "GC Time", "Input Size / Records"}
    assert (got["Duration"]["median"], got["Duration"]["max"], got["Duration"]["stage_id"]) == (10.0, 42.0, 65)
    assert got["Input Size / Records"]["min"] == 192 * 1024


def test_environment_and_coverage(spark, pages):
    texts = [
        ("a", "/a/1", "| Key | Value |\n|---|---|\n| spark.executor.cores | 2 |\n"),
        ("a", "/a/2", "<tr><td>spark.executor.cores</td><td>\n <b>8</b> &amp; up</td></tr>"),
        ("b", "/b/1", "no settings here"),
        ("b", "/b/2", "x\ty\n"),
    ]
    more = spark.createDataFrame(texts, "case string, path string, text string")
    pairs = C.environment_pairs(pages.where(F.col("path").endswith("jobs.txt")).unionByName(more))
    assert ("one", "/c/one/jobs.txt", "spark.sql.shuffle.partitions", "200") in rows(pairs)
    assert not [r for r in rows(pairs) if r[2] == "spark.driver.extra"]
    cover = {(r["case"], r["key"]): r["value"] for r in C.resource_coverage(pairs).collect()}
    assert cover[("a", "spark.executor.cores")] == "8 & up" and cover[("one", "spark.executor.cores")] == "4"
    assert cover[("b", "spark.executor.cores")] is None and len(cover) == 3 * len(C.RESOURCE_KEYS)
    assert C.missing_resources(pairs).count() == 3 * len(C.RESOURCE_KEYS) - 3


def test_text_tables_pad_and_skip(spark):
    text = "Title\n\nName\tSize\tFiles\nalpha\t1\nsolo\n\n one   two\n three  four   five\n\nx  y\n"
    df = spark.createDataFrame([("c", "p", text)], "case string, path string, text string")
    got = [(r["block_no"], r["row_no"], list(r["cells"])) for r in C.text_tables(df).orderBy("block_no", "row_no").collect()]
    assert got == [(1, 0, ["Name", "Size", "Files"]), (1, 1, ["alpha", "1", ""]), (2, 0, ["one", "two", ""]), (2, 1, ["three", "four", "five"])]


def test_table_references(spark):
    text = "FROM dm.dwd_a x JOIN dm.other_b\nfrom {db_prefix}ods.mbs_c WHERE 1\n'{db_prefix}ods.mbs_c' join a.b.dwd_c from dwd_only"
    df = spark.createDataFrame([("c", text)], "case string, text string")
    assert rows(C.table_references(df).select("table_name")) == [("dm.dwd_a",), ("ods.mbs_c",)]


def test_read_pages_keeps_whole_files(spark, tmp_path):
    folder = tmp_path / "case_x"
    folder.mkdir()
    (folder / "jobs.txt").write_text("a\nb\n")
    (folder / "skip.bin").write_text("no")
    got = read_pages(spark, str(tmp_path)).collect()
    assert [(r["case"], r["text"]) for r in got] == [("case_x", "a\nb\n")]


def test_evidence_rules(spark):
    stages = spark.createDataFrame([("r", 2_000_000_000, 1.0, 10.0), ("r", 1, 3.0e12, 2000.0), ("s", 1, 1.0, 1.0)], "run string, n long, b double, t double")
    assert rows(E.size_findings(stages, ["run"], "n", "b", "t", many=1)) == [("r", 2, 1, 1, 1, 2, 1), ("s", 1, 0, 0, 0, 0, 0)]
    tasks = spark.createDataFrame([("a", float(v)) for v in [1, 1, 1, 1, 9]] + [("b", 5.0)] * 4, "stage string, t double")
    assert {r["stage"]: r["shape"] for r in E.task_distribution(tasks, ["stage"], "t").collect()} == {"a": "long_tail", "b": "volume"}
    before = spark.createDataFrame([("x", 10.0), ("y", 0.0), ("gone", 1.0)], "metric string, value double")
    after = spark.createDataFrame([("x", 5.0), ("y", 2.0), ("new", 3.0)], "metric string, value double")
    got = {r["metric"]: (r["change"], r["change_pct"]) for r in E.compare_runs(before, after).collect()}
    assert got == {"x": (-5.0, -50.0), "y": (2.0, None), "gone": (None, None), "new": (None, None)}
    findings = spark.createDataFrame([("c", "scan", 5, 2, True), ("c", "scan", 9, 3, False), ("c", "skew", 9, 1, False)],
                                     "case string, cause string, impact int, risk int, confirmed boolean")
    ranked = [(r["cause"], r["rank"], r["findings"], r["status"]) for r in E.rank_findings(findings).orderBy("rank").collect()]
    assert ranked == [("skew", 1, 1, "to confirm"), ("scan", 2, 2, "confirmed")]
    reads = spark.createDataFrame([("t", "d1", "r1"), ("t", "d1", "r2"), ("t", "d2", "r1"), ("t", "d2", "r1")], "tab string, part string, run string")
    assert rows(E.repeated_scans(reads, "tab", "part", "run")) == [("t", "d1", 2, 2)]


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.range(100).repartition(5).write.parquet(path)
    got = E.small_files(file_footers(spark, path)).first()
    assert (got["files"], got["small_files"]) == (5, 1)


def test_pages_are_made_and_looked_at_once(spark):
    """The kind of a page is no filter below the shuffle that deals its rows out, where few tasks would make every page."""
    made = spark.range(8).repartition(3).select(
        F.lit("one").alias("case"), F.lit("/c").alias("path"), F.concat(F.lit(DETAIL), "id", F.lit("\n"), F.lit(STAGES)).alias("text")
    )
    for read in (C.task_rows, C.stage_summary, C.stage_rows, C.job_rows, C.executor_rows):
        below = read(made)._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1]
        assert "Filter" not in below


def test_entries_at_their_edges(spark):
    """Carriage returns, starts without an end, ends too early or twice, and sizes that are another line."""
    times = "2026/06/05 11:34:09\t2 s\t\n"
    stages = NAV + "Stages for All Jobs\n1\t\n" + times + "1/2\nb\n" + times + "3/4 (1 failed)\n1.5 GiB\t\t\t2 MiB\nc\n" + times + "5/6\n7\t\n8\t\nd\n" + times + "9/9\n9\t\ne\n" + times + "no\nf\n" + times + "2/2"
    detail = DETAIL.replace("0\t40564", "5\t1\t0\tSUCCESS\tANY\t1\th\t\n0\t40564")
    texts = [x for page in (stages, detail) for x in (page, NAV + page.removeprefix(NAV).replace("\n", "\r\n"))]
    pages = spark.createDataFrame([("c", str(i), t) for i, t in enumerate(texts)] + [("c", "n", None)], "case string, path string, text string")
    got = rows(C.stage_rows(pages).select("path", "stage_id", "action", "tasks_done", "failed", "input_bytes", "shuffle_write_bytes", "duration_s"))
    one = [(1, "b", 3, 1, 1.5 * 1024**3, 2.0 * 1024**2, 2.0), (8, "d", 9, 0, None, None, 2.0), (9, "f", 2, 0, None, None, 2.0)]
    assert got == [(p, *x) for p in "01" for x in one]
    tasks = rows(C.task_rows(pages).select("path", "task_id", "host", "duration_s", "input_records"))
    assert tasks == [(p, *x) for p in "23" for x in [(40541, "host-b.dc", 16.0, None), (40564, "host-a.dc", 13.0, 3297280)]]
