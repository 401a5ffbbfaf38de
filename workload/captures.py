"""EV* queries. Pages are rendered by Spark from the tables, one page per row."""

from pyspark.sql import functions as F

from creditloom.operators import captures as C
from creditloom.operators import evidence as E
from creditloom.session import scratch_path
from creditloom.sources.footers import file_footers
from workload.base import query, spread, table
from workload.standins import ev, loan_daily

NAV = "3.2.1\nJobs\nStages\nStorage\nEnvironment\nExecutors\nSQL\n"


def page(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def kinds():
    """Heading by event type; the file name is deliberately that of another page."""
    heading = {
        "click": "Spark Jobs (?)", "view": "Stages for All Jobs", "purchase": "Executors",
        "error": "Details for Stage ", "signup": "Environment",
    }
    out = F.when(F.lit(False), F.lit(""))
    for kind, text in heading.items():
        value = page(text, F.col("k"), " (Attempt ", F.col("k") % 3, ")") if kind == "error" else F.lit(text)
        out = out.when(F.col("event_type") == kind, value)
    return out.otherwise("Something else")


def mixed_pages(spark, d):
    return spread(ev(spark, d)).select(
        page("case", F.col("user_id")).alias("case"),
        page("/captures/case", F.col("user_id"), "/jobs_", F.col("event_id"), ".txt").alias("path"),
        page(NAV, "etl_", F.col("user_id"), " application UI\n", kinds(), "\nbody application_1700000000_", F.col("event_id"), "\n")
        .alias("text"),
        "event_id",
    )


_KIND = """CASE event_type WHEN 'click' THEN 'jobs' WHEN 'view' THEN 'stages' WHEN 'purchase' THEN 'executors'
  WHEN 'error' THEN 'stage_detail' WHEN 'signup' THEN 'environment' ELSE 'unknown' END"""
_HEADING = """CASE event_type WHEN 'click' THEN 'Spark Jobs (?)' WHEN 'view' THEN 'Stages for All Jobs'
  WHEN 'purchase' THEN 'Executors' WHEN 'error' THEN 'Details for Stage ' || k || ' (Attempt ' || (k % 3) || ')'
  WHEN 'signup' THEN 'Environment' ELSE 'Something else' END"""


@query("ev1_classify_pages", f"""
SELECT event_id, {_KIND} AS page_kind, 'etl_' || user_id AS app_name, 'application_1700000000_' || event_id AS app_id,
  CASE WHEN event_type = 'error' THEN k END AS stage_id, CASE WHEN event_type = 'error' THEN k % 3 END AS attempt FROM ev""", ["ev"])
def ev1(spark, d):
    out = C.classify_pages(mixed_pages(spark, d))
    return out.select("event_id", "page_kind", "app_name", "app_id", "stage_id", "attempt")


def environment_pages(spark, d):
    """Settings as HTML rows, pipe rows or tab lines; some keys are missing, some come twice."""
    k = F.col("k")
    cores = F.when(k % 4 != 0, k % 8 + 1)
    html = page(
        "<html><table><tr><td>spark.executor.instances</td><td><b> ", k, "  x &amp; y</b></td></tr>\n<tr><td>spark.app.name</td>",
        "<td>a &lt;", F.col("user_id"), "&gt;</td></tr>",
        F.when(cores.isNotNull(), page("<tr><td>spark.executor.cores</td><td>", cores, "</td></tr>")).otherwise(""),
        "</table>\nJobs\tx\n",
    )
    pipes = page(
        "# Report\n\n| Key | Value |\n|---|:--|\n| spark.executor.instances | 1 |\n| spark.executor.instances | ", k,
        " x &amp; y |\n| spark.app.name |  a &lt;", F.col("user_id"), "&gt; |\n",
        F.when(cores.isNotNull(), page("| spark.executor.cores | ", cores, " |\n")).otherwise(""), "| Jobs | 3 |\nend\n",
    )
    tabs = page(
        "Spark Properties\nName\tValue\nspark.executor.instances\t", k, " x &amp; y\nspark.app.name\ta &lt;", F.col("user_id"),
        "&gt;\t\n", F.when(cores.isNotNull(), page("spark.executor.cores\t", cores, "\n")).otherwise(""), "empty\t\nJobs\t7\n",
    )
    fmt = F.col("event_id") % 3
    return spread(ev(spark, d)).select(
        page("case", F.col("user_id")).alias("case"),
        F.format_string("/captures/%d/env_%08d.txt", "user_id", "event_id").alias("path"),
        F.when(fmt == 0, html).when(fmt == 1, pipes).otherwise(tabs).alias("text"),
    )


_PAIRS = """
e AS (SELECT 'case' || user_id AS "case", printf('/captures/%d/env_%08d.txt', user_id, event_id) AS path, k, user_id FROM ev),
pr AS (SELECT "case", path, 'spark.executor.instances' AS key, k || ' x & y' AS value FROM e
  UNION ALL SELECT "case", path, 'spark.app.name', 'a <' || user_id || '>' FROM e
  UNION ALL SELECT "case", path, 'spark.executor.cores', '' || (k % 8 + 1) FROM e WHERE k % 4 <> 0)"""


@query("ev2_environment_pairs", f"WITH {_PAIRS} SELECT * FROM pr", ["ev"])
def ev2(spark, d):
    return C.environment_pairs(environment_pages(spark, d))


def document_pages(spark, d):
    """Whole documents with a pipe table in front and aligned text behind."""
    doc = F.col("doc_id")
    head = page("| Metric | Value |\n|:--|--:|\n| docs &amp; pages |  ", doc, " |\n | ", F.col("lang"), " | ", F.col("n_chars"), " | x |\n")
    body = F.translate(F.col("text"), "|\t\n\r", "    ")
    body = F.regexp_replace(body, " +", " ")
    tail = page("\nName\tSize\tFiles\nalpha\t", doc, "\nonly one\n\nsource   ", F.col("source"), "\nlang  ", F.col("lang"), "   extra\n\nsolo  pair\n")
    return spread(table(spark, d, "documents")).select(
        F.col("lang").alias("case"), page("/captures/doc_", doc).alias("path"), page(head, body, "\n", tail).alias("text"), "doc_id"
    )


@query("ev3_markdown_rows", """
SELECT '/captures/doc_' || doc_id AS path, 0 AS line_no, 'Metric~Value' AS cells FROM documents
UNION ALL SELECT '/captures/doc_' || doc_id, 2, 'docs & pages~' || doc_id FROM documents
UNION ALL SELECT '/captures/doc_' || doc_id, 3, lang || '~' || n_chars || '~x' FROM documents""")
def ev3(spark, d):
    rows = C.markdown_rows(document_pages(spark, d))
    return rows.select("path", "line_no", F.concat_ws("~", "cells").alias("cells"))


@query("ev4_text_tables", """
SELECT '/captures/doc_' || doc_id AS path, 1 AS block_no, 0 AS row_no, 'Name~Size~Files' AS cells FROM documents
UNION ALL SELECT '/captures/doc_' || doc_id, 1, 1, 'alpha~' || doc_id || '~' FROM documents
UNION ALL SELECT '/captures/doc_' || doc_id, 2, 0, 'source~' || source || '~' FROM documents
UNION ALL SELECT '/captures/doc_' || doc_id, 2, 1, 'lang~' || lang || '~extra' FROM documents""")
def ev4(spark, d):
    rows = C.text_tables(document_pages(spark, d))
    return rows.select("path", "block_no", "row_no", F.concat_ws("~", "cells").alias("cells"))


_KEYS = "unnest(['" + "', '".join(C.RESOURCE_KEYS) + "'])"


@query("ev5_resource_coverage", f"""WITH {_PAIRS},
w AS (SELECT "case", {_KEYS} AS key FROM (SELECT DISTINCT "case" FROM pr)),
l AS (SELECT "case", key, arg_max(value, path) AS value FROM pr GROUP BY ALL)
SELECT w."case", w.key, value, CASE WHEN value IS NULL THEN 'missing' ELSE 'found' END AS status
FROM w LEFT JOIN l ON l."case" = w."case" AND l.key = w.key""", ["ev"])
def ev5(spark, d):
    return C.resource_coverage(C.environment_pairs(environment_pages(spark, d)))


@query("ev5_missing_resources", f"""WITH {_PAIRS}
SELECT "case", {_KEYS} AS key FROM (SELECT DISTINCT "case" FROM pr) EXCEPT SELECT "case", key FROM pr""", ["ev"])
def ev5_missing(spark, d):
    return C.missing_resources(C.environment_pairs(environment_pages(spark, d)))


def source_texts(spark, d):
    brand = F.lower(F.regexp_replace("p_brand", "#", "_"))
    return table(spark, d, "part").select(
        F.col("p_type").alias("case"),
        page(
            "class Dao:\n  table = {'a': f'{db_prefix}ods.mbs_", brand, "'}\n  sql = f'''SELECT x from dwh.dwd_", F.col("p_size"),
            "_di a\n  JOIN  dim_only b join raw.zzz_", F.col("p_size"), " c LEFT JOIN mart.ads_x.y d FROM {db_prefix}fin.fct_", brand, "'''\n",
        ).alias("text"),
    )


@query("ev6_table_references", """WITH b AS (SELECT p_type AS "case", lower(replace(p_brand, '#', '_')) AS brand, p_size FROM part)
SELECT DISTINCT "case", 'ods.mbs_' || brand AS table_name FROM b
UNION SELECT "case", 'fin.fct_' || brand FROM b UNION SELECT "case", 'dwh.dwd_' || p_size || '_di' FROM b""")
def ev6(spark, d):
    return C.table_references(source_texts(spark, d))


@query("ev7_table_profile", """
SELECT count(DISTINCT pt_date) AS partitions, count(DISTINCT pt_date) FILTER (pt_date BETWEEN '1998-01-01' AND '1998-06-30')
  AS window_partitions, count(*) FILTER (pt_date BETWEEN '1998-01-01' AND '1998-06-30') AS window_rows, count(*) AS total_rows
FROM loan_daily""", ["loan_daily"])
def ev7(spark, d):
    return E.scanned_profile(loan_daily(spark, d), "pt_date", "1998-01-01", "1998-06-30")


def stored_lines(spark, d):
    """Line items as a table by return flag and line number, one file for each pair; the table's folder."""
    path = scratch_path(spark, "lines")
    keys = ["l_returnflag", "l_linenumber"]
    lines = table(spark, d, "lineitem").select(*keys, "l_orderkey", "l_extendedprice")
    lines.repartition(*keys).write.partitionBy(*keys).parquet(path)
    return path


@query("ev7_footer_profile", """
SELECT count(DISTINCT l_linenumber) AS partitions, count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 2 AND 4) AS window_partitions,
  count(*) FILTER (l_linenumber BETWEEN 2 AND 4) AS window_rows, count(*) AS total_rows,
  count(DISTINCT (l_returnflag, l_linenumber)) AS files, true AS has_bytes FROM lineitem""")
def ev7_footers(spark, d):
    files = file_footers(spark, stored_lines(spark, d), ["l_linenumber"])
    profile = E.table_profile(files, "l_linenumber", "2", "4")
    return profile.withColumn("has_bytes", F.col("total_bytes") > F.col("total_rows")).drop("total_bytes")


@query("ev7_partition_rows", "SELECT pt_date, count(*) AS n_rows FROM loan_daily GROUP BY 1", ["loan_daily"])
def ev7_rows(spark, d):
    return E.partition_rows(loan_daily(spark, d), "pt_date")


def stage_pages(spark, d):
    """Stage pages: even lines keep the tabs of empty cells, odd lines have lost them; line 7 has no sizes."""
    line, qty = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    done = F.col("l_partkey").cast("int") % 500 + 1
    retries = F.when(line == 3, page(" (", qty, " failed)")).when(
        line == 5, page(" (", qty, " killed: another attempt succeeded)(2 killed: Stage finished)")
    ).otherwise("")
    gib = F.col("l_suppkey").cast("int") % 90 + 1
    sizes = F.when(line == 7, "").when(line % 2 == 0, page("\n", gib, ".5 GiB\t\t\t", qty, ".0 MiB")).otherwise(
        page("\n", gib, ".5 GiB\t", qty, ".0 MiB")
    )
    listing = F.when(line == 5, "Listing leaf files and directories for 3 paths:\nhdfs://a/pt_date=1, ...\n").otherwise("")
    text = page(
        NAV, "etl application UI\nStages for All Jobs\nCompleted Stages: 1\n1 Pages. Jump to\n1\n. Show\n100\nitems in a page.\n",
        "Stage Id\nDescription\nSubmitted\nDuration\nTasks: Succeeded/Total\t\nInput\n", F.col("l_orderkey"), "\t\n", listing,
        "save at X.java:0+details\n", F.when(line == 6, "Unknown").otherwise(F.date_format("l_shipdate", "yyyy/MM/dd HH:mm:ss")),
        "\t", qty, F.when(line % 2 == 0, " min").otherwise(".5 s"), "\t\n", done, "/500", retries, sizes,
        "\n999999\t\nlast at Y.java:1+details\n2026/06/05 13:49:59\tUnknown\t\n0/4\n1 Pages. Jump to\n1\n",
    )
    return spread(table(spark, d, "lineitem")).select(
        page("case", F.col("l_suppkey")).alias("case"), page("/c/", F.col("l_orderkey")).alias("path"), text.alias("text")
    )


@query("ev8_stage_rows", """
WITH s AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n FROM lineitem)
SELECT 'case' || l_suppkey AS "case", CAST(l_orderkey AS INTEGER) AS stage_id, 'save at X.java:0' AS action,
  CASE WHEN n <> 6 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS submitted,
  CASE WHEN n % 2 = 0 THEN q * 60.0::DOUBLE ELSE q + 0.5::DOUBLE END AS duration_s,
  CAST(l_partkey % 500 + 1 AS INTEGER) AS tasks_done, 500 AS tasks_total, CASE WHEN n = 3 THEN q ELSE 0 END AS failed,
  CASE WHEN n = 5 THEN q + 2 ELSE 0 END AS killed,
  CASE WHEN n % 2 = 0 THEN (l_suppkey % 90 + 1.5::DOUBLE) * 1073741824 END AS input_bytes, CAST(NULL AS DOUBLE) AS output_bytes,
  CASE WHEN n % 2 = 0 THEN q * 1048576.0::DOUBLE END AS shuffle_write_bytes, n % 2 = 0 AS sizes_known
FROM s
UNION ALL SELECT 'case' || l_suppkey, 999999, 'last at Y.java:1', '2026-06-05 13:49:59', NULL, 0, 4, 0, 0, NULL, NULL, NULL, false
FROM lineitem""")
def ev8(spark, d):
    rows = C.stage_rows(stage_pages(spark, d)).drop("path", "app_name", "shuffle_read_bytes", "sizes_text")
    return rows.withColumn("submitted", F.date_format("submitted", "yyyy-MM-dd HH:mm:ss"))


def job_pages(spark, d):
    price = F.col("o_totalprice").cast("int")
    text = page(
        NAV, "etl application UI\nSpark Jobs (?)\nUser: x\nTotal Uptime: 4.5 h\nCompleted Jobs: 1\n1 Pages. Jump to\n1\n. Show\n",
        "Job Id (Job Group)\nDescription\nStages: Succeeded/Total\tTasks (for all stages): Succeeded/Total\n", F.col("o_orderkey"),
        F.when(price % 5 == 0, " (bf79-41 run)").otherwise(""), "\t\nsave at X.java:0\nsave at X.java:0\t", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"), "\t1.5 h\t1/", price % 9 + 1,
        F.when(price % 2 == 0, " (3 skipped)\t\n").otherwise("\t\n"), price % 400, "/400",
        F.when(price % 3 == 0, page(" (", price % 7, " failed) (11 skipped)")).otherwise(""), "\n",
    )
    return spread(table(spark, d, "orders")).select(
        page("case", F.col("o_custkey")).alias("case"), page("/j/", F.col("o_orderkey")).alias("path"), text.alias("text")
    )


@query("ev8_job_rows", """
WITH o AS (SELECT *, CAST(trunc(o_totalprice) AS INTEGER) AS p FROM orders)
SELECT 'case' || o_custkey AS "case", CAST(o_orderkey AS INTEGER) AS job_id, 'save at X.java:0' AS action,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS submitted, 5400.0::DOUBLE AS duration_s, 1 AS stages_done, p % 9 + 1 AS stages_total,
  p % 400 AS tasks_done, 400 AS tasks_total, CASE WHEN p % 3 = 0 THEN p % 7 ELSE 0 END AS failed,
  CASE WHEN p % 3 = 0 THEN 11 ELSE 0 END AS tasks_skipped FROM o""")
def ev8_jobs(spark, d):
    rows = C.job_rows(job_pages(spark, d)).drop("path", "app_name")
    return rows.withColumn("submitted", F.date_format("submitted", "yyyy-MM-dd HH:mm:ss"))


def executor_pages(spark, d):
    def line(name, executors, extra):
        return page(
            name, "(", executors, ")\t0\t0.0 B / 82 GiB\t0.0 B\t", executors * 4, "\t", extra, "\t", extra + 1, "\t", executors * 100,
            "\t", executors * 100 + extra, "\t", executors, ".5 h (", extra, " min)\t", executors, " GiB\t2.5 TiB\t592.0 MiB\t0\n",
        )

    def executor(i):
        return page(
            F.when(i == 0, "driver").otherwise(i.cast("string")), "\thost-", i, ".dc:", i + 30000, "\t", F.when(i % 2 == 0, "Active").otherwise("Dead"),
            "\t0\t0.0 B / 8.6 GiB\t0.0 B\t4\t0\t", i, "\t", n * 100, "\t", n * 100 + i, "\t", n, ".5 h (", k, " min)\t", n, " GiB\t2.5 TiB\t592.0 MiB\t\nstdout\nstderr\n",
        )

    n, k = (F.col("o_custkey") % 40).cast("int") + 1, (F.col("o_orderkey") % 30).cast("int")
    text = page(
        NAV, "app", F.col("o_orderkey"), " application UI\nExecutors\nShow Additional Metrics\nSummary\nRDD Blocks\tStorage Memory\n",
        line("Active", n, k), line("Dead", n + 1, k + 1), line("Total", n + n + 1, k + k + 1), "Executors\nShow\n20\n entries\n",
        "Executor ID\tAddress\tStatus\tRDD Blocks\n", F.array_join(F.transform(F.sequence(F.lit(0), n % 4), executor), ""),
    )
    return spread(table(spark, d, "orders")).select(
        page("case", F.col("o_orderkey")).alias("case"), page("/e/", F.col("o_orderkey")).alias("path"), text.alias("text")
    )


_EXECUTORS = """
o AS (SELECT o_orderkey, CAST(o_custkey % 40 AS INTEGER) + 1 AS n, CAST(o_orderkey % 30 AS INTEGER) AS k FROM orders),
x AS (SELECT 'case' || o_orderkey AS "case", 'app' || o_orderkey AS app_name, 'active' AS state, n AS e, k AS f FROM o
  UNION ALL SELECT 'case' || o_orderkey, 'app' || o_orderkey, 'dead', n + 1, k + 1 FROM o
  UNION ALL SELECT 'case' || o_orderkey, 'app' || o_orderkey, 'total', n + n + 1, k + k + 1 FROM o)"""


@query("ev8_executor_totals", f"""WITH {_EXECUTORS}
SELECT "case", state, e AS executors, e * 4 AS cores, f AS active_tasks, f + 1 AS failed_tasks, e * 100 AS complete_tasks,
  e * 100 + f AS total_tasks, (e + 0.5::DOUBLE) * 3600 AS task_time_s, f * 60.0::DOUBLE AS gc_time_s,
  e * 1073741824.0::DOUBLE AS input_bytes, 2.5::DOUBLE * 1099511627776 AS shuffle_read_bytes,
  592 * 1048576.0::DOUBLE AS shuffle_write_bytes FROM x""")
def ev8_executors(spark, d):
    return C.executor_totals(executor_pages(spark, d)).drop("path", "app_name")


@query("ev8_executor_rows", """
WITH o AS (SELECT o_orderkey, CAST(o_custkey % 40 AS INTEGER) + 1 AS n, CAST(o_orderkey % 30 AS INTEGER) AS k FROM orders),
x AS (SELECT *, CAST(unnest(range(n % 4 + 1)) AS INTEGER) AS i FROM o)
SELECT 'case' || o_orderkey AS "case", CASE WHEN i = 0 THEN 'driver' ELSE '' || i END AS executor_id, 'host-' || i || '.dc' AS host,
  CASE WHEN i % 2 = 0 THEN 'active' ELSE 'dead' END AS state, 4 AS cores, 0 AS active_tasks, i AS failed_tasks,
  n * 100 AS complete_tasks, n * 100 + i AS total_tasks, (n + 0.5::DOUBLE) * 3600 AS task_time_s, k * 60.0::DOUBLE AS gc_time_s,
  n * 1073741824.0::DOUBLE AS input_bytes, 2.5::DOUBLE * 1099511627776 AS shuffle_read_bytes,
  592 * 1048576.0::DOUBLE AS shuffle_write_bytes FROM x""")
def ev8_each_executor(spark, d):
    return C.executor_rows(executor_pages(spark, d)).drop("path", "app_name")


@query("ev16_executor_summary", f"""WITH {_EXECUTORS}
SELECT "case", app_name, max(e) FILTER (state = 'active') AS active, max(e) FILTER (state = 'dead') AS dead,
  max(e) FILTER (state = 'total') AS total, max(e * 4) FILTER (state = 'total') AS cores,
  max(f + 1) FILTER (state = 'total') AS failed_tasks, max(e * 100) FILTER (state = 'total') AS complete_tasks,
  max(e * 100 + f) FILTER (state = 'total') AS total_tasks, max((e + 0.5::DOUBLE) * 3600) FILTER (state = 'total') AS task_time_s,
  max(f * 60.0::DOUBLE) FILTER (state = 'total') AS gc_time_s FROM x GROUP BY ALL""")
def ev16(spark, d):
    return C.executor_summary(C.executor_totals(executor_pages(spark, d)))


def detail_pages(spark, d):
    q = F.col("l_quantity").cast("int")

    def task(i):
        return page(
            i, "\t", i + 40000, "\t0\t", F.when(i == 1, "FAILED").otherwise("SUCCESS"), "\tNODE_LOCAL\t", q, "\thost-", i, ".dc\t\nstdout\nstderr\n",
            "2026-06-05 11:09:45\t", q, " s\t0.5 s\t", q, ".5 MiB / ", i + 7, "\t1.5 GiB / ", q, "\t\n",
        )

    text = page(
        NAV, "etl application UI\nDetails for Stage ", F.col("l_orderkey"), " (Attempt 0)\nTotal Time Across All Tasks: 33.0 h\n",
        "Summary Metrics for 200 Completed Tasks\nMetric\tMin\t25th percentile\tMedian\t75th percentile\tMax\nDuration\t0.8 s\t", q,
        " s\t", q + 1, " s\t12 s\t", q + 40, " min\nInput Size / Records\t192 KiB / 0\t59.0 MiB / 22\t", q, ".5 MiB / 23\t87.0 MiB / 32\t",
        q, " GiB / 33\nShowing 1 to 4 of 4 entries\nIndex\tTask ID\tAttempt\tStatus\tLocality level\tExecutor ID\tHost\tLogs\tLaunch Time\t",
        "Duration\tGC Time\tInput Size / Records\tShuffle Write Size / Records\tErrors\n",
        F.array_join(F.transform(F.sequence(F.lit(0), q % 3), task), ""), "Showing 1 to 3 of 3 entries\n",
    )
    return spread(table(spark, d, "lineitem")).select(
        page("case", F.col("l_suppkey")).alias("case"), page("/d/", F.col("l_orderkey")).alias("path"), text.alias("text")
    )


@query("ev9_stage_summary", """
WITH s AS (SELECT 'case' || l_suppkey AS "case", CAST(l_orderkey AS INTEGER) AS stage_id, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT "case", stage_id, 'Duration' AS metric, 0.8::DOUBLE AS min, q::DOUBLE AS p25, q + 1.0::DOUBLE AS median, 12.0::DOUBLE AS p75,
  (q + 40) * 60.0::DOUBLE AS max FROM s
UNION ALL SELECT "case", stage_id, 'Input Size / Records', 196608.0::DOUBLE, 61865984.0::DOUBLE, (q + 0.5::DOUBLE) * 1048576,
  91226112.0::DOUBLE, q * 1073741824.0::DOUBLE FROM s""")
def ev9_pages(spark, d):
    return C.stage_summary(detail_pages(spark, d)).drop("path", "app_name", "attempt")


@query("ev9_task_rows", """
WITH s AS (SELECT 'case' || l_suppkey AS "case", CAST(l_orderkey AS INTEGER) AS stage_id, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
t AS (SELECT *, unnest(range(q % 3 + 1)) AS i FROM s)
SELECT "case", stage_id, 0 AS stage_attempt, CAST(i + 40000 AS BIGINT) AS task_id, 0 AS attempt,
  CASE WHEN i = 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status, 'NODE_LOCAL' AS locality, '' || q AS executor_id, 'host-' || i || '.dc' AS host,
  '2026-06-05 11:09:45' AS launched, q::DOUBLE AS duration_s, 0.5::DOUBLE AS gc_time_s, (q + 0.5::DOUBLE) * 1048576 AS input_bytes,
  CAST(i + 7 AS BIGINT) AS input_records, CAST(NULL AS DOUBLE) AS shuffle_read_bytes, CAST(NULL AS BIGINT) AS shuffle_read_records,
  1.5::DOUBLE * 1073741824 AS shuffle_write_bytes, CAST(q AS BIGINT) AS shuffle_write_records FROM t""")
def ev9_tasks(spark, d):
    rows = C.task_rows(detail_pages(spark, d)).drop("path", "app_name")
    return rows.withColumn("launched", F.date_format("launched", "yyyy-MM-dd HH:mm:ss"))


@query("ev9_task_distribution", """
WITH p AS (SELECT l_suppkey, count(*) AS tasks, min(l_quantity) AS min, quantile_disc(l_quantity, 0.25) AS p25,
  quantile_disc(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.75) AS p75, quantile_disc(l_quantity, 0.95) AS p95,
  quantile_disc(l_quantity, 0.99) AS p99, max(l_quantity) AS max FROM lineitem GROUP BY 1)
SELECT *, max / median AS max_to_median, CASE WHEN max / median >= 2 THEN 'long_tail' ELSE 'volume' END AS shape FROM p""")
def ev9(spark, d):
    return E.task_distribution(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", tail=2.0)


@query("ev10_size_findings", """
SELECT l_suppkey, count(*) AS stages, count(*) FILTER (l_partkey > 1900) AS over_rows,
  count(*) FILTER (l_extendedprice > 90000) AS over_bytes, count(*) FILTER (l_quantity > 49) AS over_time,
  count(*) FILTER (l_partkey > 1900 OR l_extendedprice > 90000 OR l_quantity > 49) AS huge,
  CASE WHEN count(*) FILTER (l_partkey > 1900 OR l_extendedprice > 90000 OR l_quantity > 49) > 80 THEN 1 ELSE 0 END AS materialise
FROM lineitem GROUP BY 1""")
def ev10(spark, d):
    return E.size_findings(
        table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", "l_extendedprice", "l_quantity", 1900, 90000, 49, 80
    )


@query("ev11_small_files", """
SELECT l_returnflag, count(DISTINCT l_linenumber) AS files, 1 AS small_files, count(*) AS rows FROM lineitem GROUP BY 1""")
def ev11(spark, d):
    files = file_footers(spark, stored_lines(spark, d), ["l_returnflag"])
    counted = files.groupBy("l_returnflag").agg(F.sum("rows").alias("rows"))
    found = E.small_files(files, ["l_returnflag"]).drop("total_bytes", "mean_bytes")
    return found.join(counted, "l_returnflag")


@query("ev12_hot_keys", """
WITH c AS (SELECT l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1)
SELECT l_suppkey, n_rows, n_rows::DOUBLE / (SELECT sum(n_rows)::DOUBLE FROM c) AS share,
  n_rows::DOUBLE / (SELECT sum(n_rows)::DOUBLE FROM c) * (SELECT count(*) FROM c) AS times_mean
FROM c ORDER BY n_rows DESC, l_suppkey LIMIT 10""")
def ev12(spark, d):
    return E.hot_keys(table(spark, d, "lineitem"), "l_suppkey", 10)


@query("ev13_row_inflation", """
WITH a AS (SELECT source, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS rows_after, count(*) AS rows_before FROM documents GROUP BY 1)
SELECT source, rows_before, rows_after, rows_after::DOUBLE / rows_before AS inflation FROM a""")
def ev13(spark, d):
    docs = table(spark, d, "documents").select("source", "text")
    return E.row_inflation(docs, docs.select("source", F.explode(F.split("text", " ")).alias("word")), "source")


@query("ev14_repeated_scans", """
SELECT l_suppkey, pt_month, count(DISTINCT l_orderkey) AS runs, CAST(sum(l_linenumber) AS BIGINT) AS read_total, count(*) AS reads
FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS pt_month FROM lineitem) GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 1""")
def ev14(spark, d):
    reads = table(spark, d, "lineitem").withColumn("pt_month", F.date_format("l_shipdate", "yyyy-MM"))
    return E.repeated_scans(reads, "l_suppkey", "pt_month", "l_orderkey", "l_linenumber")


@query("ev15_compare_runs", """
WITH m AS (SELECT 's' || l_suppkey || '_' || l_linenumber AS metric, sum(l_quantity) FILTER (l_returnflag = 'A') AS a,
  sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
p AS (SELECT 'A-N' AS runs, metric, a AS before, n AS after FROM m UNION ALL SELECT 'N-R', metric, n, r FROM m)
SELECT runs, metric, before, after, after - before AS change, (after - before) / nullif(before, 0) * 100 AS change_pct FROM p
WHERE before IS NOT NULL OR after IS NOT NULL""")
def ev15(spark, d):
    """Three runs, each beside the one before it."""
    lines = table(spark, d, "lineitem")
    metric = page("s", F.col("l_suppkey"), "_", F.col("l_linenumber")).alias("metric")

    def run(flag):
        return lines.where(F.col("l_returnflag") == flag).groupBy(metric).agg(F.sum("l_quantity").alias("value"))

    pairs = [E.compare_runs(run(x), run(y)).withColumn("runs", F.lit(f"{x}-{y}")) for x, y in ("AN", "NR")]
    return pairs[0].unionByName(pairs[1])


@query("ev17_rank_findings", """
WITH f AS (SELECT l_suppkey AS "case", l_returnflag || l_linenumber AS cause, max(l_quantity) AS impact, min(l_discount) AS risk,
  count(*) AS findings, max(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "case" ORDER BY impact DESC, risk, cause) AS INTEGER) AS rank FROM f)
SELECT "case", cause, impact, risk, findings, rank, CASE WHEN ok = 1 THEN 'confirmed' ELSE 'to confirm' END AS status
FROM r WHERE rank <= 5""")
def ev17(spark, d):
    findings = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("case"), page(F.col("l_returnflag"), F.col("l_linenumber")).alias("cause"),
        F.col("l_quantity").alias("impact"), F.col("l_discount").alias("risk"), (F.col("l_tax") > 0.07).alias("confirmed"),
    )
    return E.rank_findings(findings)


@query("ev18_capture_manifest", f"""
SELECT 'case' || user_id AS "case", 'jobs_' || event_id || '.txt' AS file_name, {_KIND} AS page_kind, {_HEADING} AS title,
  'etl_' || user_id AS app_name FROM ev""", ["ev"])
def ev18(spark, d):
    return C.capture_manifest(mixed_pages(spark, d)).drop("chars")


@query("ev_html_links", """
SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""")
def ev_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(links).alias("links"))


@query("ev12_hot_words", """
WITH w AS (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents),
c AS (SELECT word, count(*) AS n_rows FROM w GROUP BY 1)
SELECT word, n_rows, n_rows::DOUBLE / (SELECT sum(n_rows)::DOUBLE FROM c) AS share,
  n_rows::DOUBLE / (SELECT sum(n_rows)::DOUBLE FROM c) * (SELECT count(*) FROM c) AS times_mean
FROM c ORDER BY n_rows DESC, word LIMIT 10""")
def ev12_words(spark, d):
    """Words of all texts: far more keys than the sketch holds."""
    words = F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word")
    return E.hot_keys(table(spark, d, "documents").select(words), "word", 10, 1024)
