"""Tables out of captured Spark UI pages.

``pages`` frames have ``case``, ``path`` and ``text`` (one whole page per row); everything is
extracted inside the row, so many captures are read in parallel and nothing is grouped by page.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.columns import ladder

# Settings that describe the resources of a job.
RESOURCE_KEYS = [
    "spark.executor.instances",
    "spark.executor.cores",
    "spark.executor.memory",
    "spark.executor.memoryOverhead",
    "spark.dynamicAllocation.enabled",
    "spark.dynamicAllocation.minExecutors",
    "spark.dynamicAllocation.maxExecutors",
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.localShuffleReader.enabled",
    "spark.sql.adaptive.coalescePartitions.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.default.parallelism",
    "spark.sql.files.maxPartitionBytes",
    "spark.eventLog.dir",
]

# Prefixes of warehouse table names.
TABLE_PREFIXES = [
    "ads_", "cdm_", "dim_", "dwd_", "mbs_", "fct_", "mid_", "ods_", "tmp_", "bmart_", "fmart_",
]

# Header cells and page names that are no settings.
HEADER_KEYS = ["Key", "Name", "Metric"]
HEADER_VALUES = ["Value", "Description"]
PAGE_WORDS = ["Jobs", "Stages", "Executors", "SQL", "Environment", "Storage"]

# Units of the UI.
BYTE_UNITS = {"B": 1.0, "KiB": 1024.0, "MiB": 1024.0**2, "GiB": 1024.0**3, "TiB": 1024.0**4, "PiB": 1024.0**5}
TIME_UNITS = {"ms": 0.001, "s": 1.0, "min": 60.0, "h": 3600.0}

# HTML entities; the ampersand comes last so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}

STAMP = r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d"
# Entries are found in whole pages, where (?d) leaves only \n to end lines. Nothing but single characters is
# repeated, because a repeated group would recurse once per line, and what cannot match is not tried again (*+).
EOL = r"[\r\x{85}\x{2028}\x{2029}]?$"
STAGE_START = r"\d+\t" + EOL
SIZES = r"\d (?:B|KiB|MiB|GiB|TiB|PiB)(?:\t|" + EOL + ")"
# Action, times, tasks and, maybe, sizes.
STAGE_END = (
    r"[^\n]*+\n(?:" + STAMP + r"|Unknown)\t[^\t\n]*\t?[\r\x{85}\x{2028}\x{2029}]?\n\d+/\d+[^\n]*+"
    r"(?:\n(?=[^\n]*" + SIZES + r")[^\n]*+)?"
)
# A job id may be followed by its group in brackets.
JOB_START = r"\d+(?: \([^)\n]*\))?\t" + EOL
JOB_END = r"[^\n]*\t(?:" + STAMP + r"|Unknown)\t[^\t\n]*\t[^\n]*+\n\d+/\d+[^\n]*+"
TASK_START = r"\d+\t\d+\t\d+[^\t\n]*\t[A-Z]+\t[A-Z_]+\t[^\n]*+"
TASK_END = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\t[^\n]*+"
TASK_HEADER = r"(?md)^Index\tTask ID\t[^\n]*+"
EXECUTOR_LINE = r"(?md)^(?:driver|\d+)\t[^\t\n]+:\d+\t(?:Active|Dead)[^\n]*+"
EXECUTOR_TOTAL = r"(?md)^(?:Active|Dead|Total)\(\d+\)\t[^\n]*+"
SUMMARY_ENTRY = r"(?m)^[A-Z][^\t\n]*\t[^\t\n]*\d[^\t\n]*\t[^\t\n]+\t[^\t\n]+\t[^\t\n]+\t[^\t\n]+$"


def decode_entities(col: Column) -> Column:
    for entity, char in ENTITIES.items():
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def squeeze(col: Column) -> Column:
    """Entities decoded, runs of blanks reduced to one, ends trimmed."""
    return F.trim(F.regexp_replace(decode_entities(col), r"\s+", " "))


def in_units(text: Column, units: dict[str, float]) -> Column:
    """Number with a unit, such as ``1314.0 GiB`` or ``4.7 min``; anything else is null."""
    words = F.split(F.trim(text), " ")
    # One look-up: a row of sizes with a ladder each makes a method too long for the JVM to compile.
    factors = F.create_map(*[F.lit(x) for of in units.items() for x in of])
    return F.get(words, F.lit(0)).try_cast("double") * F.try_element_at(factors, F.get(words, F.lit(1)))


def _unless(word: str, text: Column) -> Column:
    """Null for a word that is no number or time, as parsing it would cost an exception."""
    return F.when(text != word, text)


def to_bytes(text: Column) -> Column:
    return in_units(text, BYTE_UNITS)


def to_seconds(text: Column) -> Column:
    return in_units(text, TIME_UNITS)


def _text_or_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


# How the heading of each page begins.
HEADINGS = {
    "jobs": "Spark Jobs",
    "stages": "Stages for All Jobs",
    "stage_detail": "Details for Stage",
    "job_detail": "Details for Job",
    "executors": "Executors",
    "environment": "Environment",
    "storage": "Storage",
    "sql": "SQL",
}


def _heading() -> Column:
    return F.trim(F.regexp_extract("text", r"(?m)^.* application UI[ \t]*\n[ \t]*([^\n]*)", 1))


def classify_pages(pages: DataFrame) -> DataFrame:
    """Kind of page from its heading: file names can be wrong, the navigation bar names all pages."""
    cases = [(F.col("heading").startswith(start), kind) for kind, start in HEADINGS.items()]
    overview = (F.col("heading") == "") & F.col("text").contains("Application Overview")
    return (
        pages.withColumn("heading", _heading())
        .withColumn("page_kind", ladder([*cases, (overview, "cluster_application")], "unknown"))
        .withColumn("app_name", _app_name())
        .withColumn("app_id", _text_or_null(F.regexp_extract("text", r"(application_\d+_\d+)", 1)))
        .withColumn("stage_id", F.regexp_extract("heading", r"^Details for Stage (\d+)", 1).try_cast("int"))
        .withColumn("attempt", F.regexp_extract("heading", r"\(Attempt (\d+)\)", 1).try_cast("int"))
    )


def _app_name() -> Column:
    return _text_or_null(F.regexp_extract("text", r"(?m)^(.*) application UI[ \t]*$", 1))


def _of_kind(kind: str, found: Column) -> Column:
    """What is found in a page, or null if it is not of this kind.

    The kind is a condition of what is exploded. As a filter it would be moved below whatever makes
    the pages: every page would be made and looked at twice, once by the few tasks of a scan.
    """
    return F.when(_heading().startswith(HEADINGS[kind]), found)


def _unix(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def _lines(text: Column) -> Column:
    return F.split(_unix(text), "\n")


def _markdown_cells(line: Column) -> Column:
    inner = F.regexp_replace(line, r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), squeeze)


def _is_ruler(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.rlike(r"^[:\-\s]+$"))


def markdown_rows(pages: DataFrame) -> DataFrame:
    """Rows of pipe tables: line number and cells, without the rulers under headers."""
    lines = pages.select("case", "path", F.posexplode(_lines(F.col("text"))).alias("line_no", "raw"))
    line = F.trim(F.regexp_replace(decode_entities(F.col("raw")), r"^\s+|\s+$", ""))
    rows = lines.withColumn("line", line).where(
        F.col("line").startswith("|") & (F.length(F.regexp_replace("line", r"[^|]", "")) >= 2)
    )
    rows = rows.withColumn("cells", _markdown_cells(F.col("line")))
    return rows.where((F.size("cells") >= 2) & ~_is_ruler(F.col("cells"))).select("case", "path", "line_no", "cells")


def environment_pairs(pages: DataFrame) -> DataFrame:
    """Settings of a page as (key, value).

    HTML table rows if the page has any, else pipe-table rows, else lines with a tab. The last
    value of a repeated key counts.
    """
    html_keys = F.regexp_extract_all("text", F.lit(r"(?s)<tr><td>(.*?)</td><td>(.*?)</td></tr>"), F.lit(1))
    html_values = F.regexp_extract_all("text", F.lit(r"(?s)<tr><td>(.*?)</td><td>(.*?)</td></tr>"), F.lit(2))
    from_html = F.zip_with(
        html_keys,
        html_values,
        lambda k, v: F.struct(squeeze(k).alias("k"), squeeze(F.regexp_replace(v, r"(?s)<.*?>", "")).alias("v")),
    )
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.regexp_replace(decode_entities(x), r"^\s+|\s+$", ""))
    pipes = F.filter(
        F.transform(
            F.filter(trimmed, lambda x: x.startswith("|") & (F.length(F.regexp_replace(x, r"[^|]", "")) >= 2)),
            _markdown_cells,
        ),
        lambda c: (F.size(c) >= 2) & ~_is_ruler(c),
    )
    page_word = r"^(?:" + "|".join(PAGE_WORDS) + ")"
    from_pipes = F.filter(
        F.transform(pipes, lambda c: F.struct(F.get(c, F.lit(0)).alias("k"), F.get(c, F.lit(1)).alias("v"))),
        lambda p: ~(p["k"].isin(HEADER_KEYS) & p["v"].isin(HEADER_VALUES)) & ~p["k"].rlike(page_word),
    )
    from_tabs = F.filter(
        F.transform(
            F.filter(trimmed, lambda x: x.contains("\t")),
            lambda x: F.struct(
                F.trim(F.substring_index(x, "\t", 1)).alias("k"),
                F.regexp_replace(F.regexp_extract(x, r"(?s)^[^\t]*\t(.*)$", 1), r"^\s+|\s+$", "").alias("v"),
            ),
        ),
        lambda p: (p["k"] != "") & (p["v"] != "") & ~p["k"].isin("Name", "Value") & ~p["k"].rlike(page_word),
    )
    chosen = (
        F.when(F.size(from_html) > 0, F.filter(from_html, lambda p: p["k"] != ""))
        .when(F.size(from_pipes) > 0, from_pipes)
        .otherwise(from_tabs)
    )
    ordered = F.sort_array(F.transform(chosen, lambda p, i: F.struct(p["k"].alias("k"), i.alias("pos"), p["v"].alias("v"))))
    found = pages.select("case", "path", ordered.alias("pairs"))
    last = F.filter("pairs", lambda p, i: F.coalesce(F.get("pairs", i + 1)["k"] != p["k"], F.lit(True)))
    return found.select("case", "path", F.inline(F.transform(last, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))))


def text_tables(pages: DataFrame) -> DataFrame:
    """Blocks of aligned text as tables: block and row number, cells padded to the block's width.

    Cells are parted by tabs, or by two and more blanks where a line has no tab. Lines with one
    cell are dropped, and a block needs two rows to count.
    """

    def cells(line: Column) -> Column:
        raw = F.regexp_replace(line, r"^\s+|\s+$", "")
        parts = F.when(raw.contains("\t"), F.split(raw, "\t")).otherwise(F.split(raw, r"\s{2,}"))
        return F.filter(F.transform(parts, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")

    blocks = pages.select("case", "path", F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("block_no", "block"))
    rows = blocks.withColumn("rows", F.filter(F.transform(_lines(F.col("block")), cells), lambda c: F.size(c) >= 2))
    rows = rows.where(F.size("rows") >= 2).withColumn("width", F.array_max(F.transform("rows", lambda c: F.size(c))))
    out = rows.select("case", "path", "block_no", "width", F.posexplode("rows").alias("row_no", "cells"))
    padding = F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))
    return out.withColumn("cells", F.concat("cells", padding)).drop("width")


def resource_coverage(pairs: DataFrame, keys: Sequence[str] = tuple(RESOURCE_KEYS)) -> DataFrame:
    """Every watched key of every case: its value from the last page that has it, or missing."""
    wanted = pairs.where(F.col("key").isin(list(keys)))
    found = wanted.groupBy("case", "key").agg(F.max_by("value", "path").alias("value"))
    watched = pairs.select("case").distinct().withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys])))
    return watched.join(found, ["case", "key"], "left").withColumn(
        "status", F.when(F.col("value").isNull(), "missing").otherwise("found")
    )


def missing_resources(pairs: DataFrame, keys: Sequence[str] = tuple(RESOURCE_KEYS)) -> DataFrame:
    """Watched keys that no page of a case shows."""
    watched = pairs.select("case").distinct().withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys])))
    return watched.join(pairs, ["case", "key"], "left_anti")


def table_references(sources: DataFrame, prefixes: Sequence[str] = tuple(TABLE_PREFIXES)) -> DataFrame:
    """Distinct ``schema.table`` names read by source texts, per case.

    Names follow FROM or JOIN, or a ``{db_prefix}`` marker in a string; the table part must start
    with a known prefix.
    """
    after_word = F.regexp_extract_all("text", F.lit(r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z0-9_.]+)"), F.lit(1))
    after_marker = F.regexp_extract_all("text", F.lit(r"\{db_prefix\}([A-Za-z0-9_.]+)"), F.lit(1))
    names = sources.select("case", F.explode(F.concat(after_word, after_marker)).alias("table_name"))
    pattern = r"^[A-Za-z0-9_]*\.(?:" + "|".join(prefixes) + r")[A-Za-z0-9_]*$"
    return names.where(F.col("table_name").rlike(pattern)).distinct()


def _entries(pages: DataFrame, kind: str, text: Column, pattern: str, more: Sequence[Column] = ()) -> DataFrame:
    """One row per match of the pattern in the text of pages of one kind."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    known = pages.select("case", "path", _app_name().alias("app_name"), *more, "text")
    return known.select("*", F.explode(_of_kind(kind, found)).alias("entry")).drop("text")


def _framed(
    pages: DataFrame, kind: str, start: str, end: str, is_end: Callable[[Column], Column],
    more: Sequence[Column] = (),
) -> DataFrame:
    """One row per line like ``start`` that lines like ``end`` follow before the next start: ``head`` and ``tail``.

    Starts and ends are found in one pass over the page. A line that could be both is a start; of
    several ends the first counts.
    """
    found = F.regexp_extract_all(_unix(F.col("text")), F.lit(f"(?md)^(?:{start}|{end})"), F.lit(0))
    marked = pages.select("case", "path", _app_name().alias("app_name"), *more, _of_kind(kind, found).alias("marks"))
    pairs = F.transform("marks", lambda x, i: F.struct(x.alias("head"), F.get("marks", i + 1).alias("tail")))
    entries = F.filter(pairs, lambda p: ~is_end(p["head"]) & is_end(p["tail"]))
    return marked.select("*", F.inline(entries)).drop("marks")


def _has_lines(mark: Column) -> Column:
    return mark.contains("\n")


def _line(i: int) -> Column:
    """Line of an entry's end; null when there are fewer."""
    return F.get("lines", F.lit(i))


def _stage_of(attempt: str) -> list[Column]:
    """Stage and attempt of a stage detail page."""
    numbers = {"stage_id": r"Stage (\d+)", attempt: r"\(Attempt (\d+)\)"}
    return [F.regexp_extract(_heading(), p, 1).try_cast("int").alias(n) for n, p in numbers.items()]


def _counted(tasks: Column, word: str) -> Column:
    """Sum of the numbers before a word in a task line; most lines have no remarks at all."""
    numbers = F.regexp_extract_all(tasks, F.lit(r"(\d+) " + word), F.lit(1))
    total = F.aggregate(numbers, F.lit(0), lambda a, x: a + x.try_cast("int"))
    return F.when(tasks.contains("("), total).otherwise(0)


def _part(fraction: Column, index: int) -> Column:
    """Numerator or denominator of ``n/m`` with remarks behind."""
    return F.get(F.split(F.substring_index(F.trim(fraction), " ", 1), "/"), F.lit(index)).try_cast("int")


def _submitted(text: Column) -> Column:
    return F.try_to_timestamp(_unless("Unknown", text), F.lit("yyyy/MM/dd HH:mm:ss"))


def stage_rows(pages: DataFrame) -> DataFrame:
    """One row per stage of the stage pages.

    An entry ends with its time, tasks and, maybe, sizes. The four size columns are known only
    where the copied text kept their tabs. Where empty cells were lost, a size cannot be told from
    its position: it stays null, ``sizes_known`` is false and ``sizes_text`` holds the page's text.
    """
    rows = _framed(pages, "stages", STAGE_START, STAGE_END, _has_lines).withColumn("lines", F.split("tail", "\n"))
    rows = rows.select(
        "case",
        "path",
        "app_name",
        F.substring_index("head", "\t", 1).try_cast("int").alias("stage_id"),
        _line(0).alias("action"),
        F.split(_line(1), "\t").alias("timing"),
        _line(2).alias("tasks"),
        F.coalesce(_line(3), F.lit("")).alias("sizes_text"),
    ).withColumn("sizes", F.split("sizes_text", "\t"))
    known = F.size("sizes") >= 4

    def size(i: int) -> Column:
        return F.when(known, to_bytes(_unless("", F.get("sizes", F.lit(i)))))

    return rows.select(
        "case",
        "path",
        "app_name",
        "stage_id",
        F.replace(F.col("action"), F.lit("+details"), F.lit("")).alias("action"),
        _submitted(F.get("timing", F.lit(0))).alias("submitted"),
        to_seconds(_unless("Unknown", F.get("timing", F.lit(1)))).alias("duration_s"),
        _part(F.col("tasks"), 0).alias("tasks_done"),
        _part(F.col("tasks"), 1).alias("tasks_total"),
        _counted(F.col("tasks"), "failed").alias("failed"),
        _counted(F.col("tasks"), "killed").alias("killed"),
        size(0).alias("input_bytes"),
        size(1).alias("output_bytes"),
        size(2).alias("shuffle_read_bytes"),
        size(3).alias("shuffle_write_bytes"),
        known.alias("sizes_known"),
        "sizes_text",
    )


def job_rows(pages: DataFrame) -> DataFrame:
    """One row per job of the job pages."""
    rows = _framed(pages, "jobs", JOB_START, JOB_END, _has_lines).withColumn("lines", F.split("tail", "\n"))
    rows = rows.select(
        "case",
        "path",
        "app_name",
        F.substring_index(F.substring_index("head", "\t", 1), " ", 1).try_cast("int").alias("job_id"),
        F.split(_line(0), "\t").alias("timing"),
        _line(1).alias("tasks"),
    )

    def cell(i: int) -> Column:
        return F.get("timing", F.lit(i))

    return rows.select(
        "case",
        "path",
        "app_name",
        "job_id",
        cell(0).alias("action"),
        _submitted(cell(1)).alias("submitted"),
        to_seconds(cell(2)).alias("duration_s"),
        _part(cell(3), 0).alias("stages_done"),
        _part(cell(3), 1).alias("stages_total"),
        _part(F.col("tasks"), 0).alias("tasks_done"),
        _part(F.col("tasks"), 1).alias("tasks_total"),
        _counted(F.col("tasks"), "failed").alias("failed"),
        _counted(F.col("tasks"), "skipped").alias("tasks_skipped"),
    )


def executor_totals(pages: DataFrame) -> DataFrame:
    """The Active, Dead and Total lines of executor pages, read by column position."""
    rows = _entries(pages, "executors", _unix(F.col("text")), EXECUTOR_TOTAL).withColumn("c", F.split("entry", "\t"))

    def cell(i: int) -> Column:
        return F.get("c", F.lit(i))

    return rows.select(
        "case",
        "path",
        "app_name",
        F.lower(F.regexp_extract(cell(0), r"^(\w+)", 1)).alias("state"),
        F.regexp_extract(cell(0), r"\((\d+)\)", 1).cast("int").alias("executors"),
        cell(4).try_cast("int").alias("cores"),
        cell(5).try_cast("int").alias("active_tasks"),
        cell(6).try_cast("int").alias("failed_tasks"),
        cell(7).try_cast("int").alias("complete_tasks"),
        cell(8).try_cast("int").alias("total_tasks"),
        to_seconds(F.substring_index(cell(9), " (", 1)).alias("task_time_s"),
        to_seconds(F.regexp_extract(cell(9), r"\(([^)]*)\)", 1)).alias("gc_time_s"),
        to_bytes(cell(10)).alias("input_bytes"),
        to_bytes(cell(11)).alias("shuffle_read_bytes"),
        to_bytes(cell(12)).alias("shuffle_write_bytes"),
    )


def executor_rows(pages: DataFrame) -> DataFrame:
    """One row per executor of executor pages, the driver included, read by column position."""
    rows = _entries(pages, "executors", _unix(F.col("text")), EXECUTOR_LINE).withColumn("c", F.split("entry", "\t"))

    def cell(i: int) -> Column:
        return F.get("c", F.lit(i))

    return rows.select(
        "case",
        "path",
        "app_name",
        cell(0).alias("executor_id"),
        F.substring_index(cell(1), ":", 1).alias("host"),
        F.lower(F.regexp_extract(cell(2), r"^(\w+)", 1)).alias("state"),
        cell(6).try_cast("int").alias("cores"),
        cell(7).try_cast("int").alias("active_tasks"),
        cell(8).try_cast("int").alias("failed_tasks"),
        cell(9).try_cast("int").alias("complete_tasks"),
        cell(10).try_cast("int").alias("total_tasks"),
        to_seconds(F.substring_index(cell(11), " (", 1)).alias("task_time_s"),
        to_seconds(F.regexp_extract(cell(11), r"\(([^)]*)\)", 1)).alias("gc_time_s"),
        to_bytes(cell(12)).alias("input_bytes"),
        to_bytes(cell(13)).alias("shuffle_read_bytes"),
        to_bytes(cell(14)).alias("shuffle_write_bytes"),
    )


def task_rows(pages: DataFrame) -> DataFrame:
    """One row per task of stage detail pages.

    The copied text puts the links to logs on lines of their own, so a task is a line up to its
    host and a line from its launch time on. Metrics are found by the names in the table's header;
    a page shows only those that the stage has.
    """
    header = F.nullif(F.regexp_extract(_unix(F.col("text")), TASK_HEADER, 0), F.lit(""))
    more = [*_stage_of("stage_attempt"), F.split(header, "\t").alias("header")]
    # A start has a tab or a digit where a date has its first dash.
    rows = _framed(pages, "stage_detail", TASK_START, TASK_END, lambda x: F.substring(x, 5, 1) == "-", more)
    rows = rows.withColumns({"head": F.split("head", "\t"), "tail": F.split("tail", "\t")})

    def cell(i: int) -> Column:
        return F.get("head", F.lit(i))

    def named(name: str) -> Column:
        at = F.array_position("header", name) - F.array_position("header", "Launch Time")
        return F.when(F.array_contains("header", name), F.get("tail", at.cast("int")))

    def sized(name: str) -> list[Column]:
        text, out = named(f"{name} Size / Records"), name.lower().replace(" ", "_")
        return [
            to_bytes(F.substring_index(text, " / ", 1)).alias(f"{out}_bytes"),
            F.substring_index(text, " / ", -1).try_cast("long").alias(f"{out}_records"),
        ]

    return rows.select(
        "case",
        "path",
        "app_name",
        "stage_id",
        "stage_attempt",
        cell(1).try_cast("long").alias("task_id"),
        cell(2).try_cast("int").alias("attempt"),
        cell(3).alias("status"),
        cell(4).alias("locality"),
        cell(5).alias("executor_id"),
        cell(6).alias("host"),
        F.try_to_timestamp(F.get("tail", F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss")).alias("launched"),
        to_seconds(named("Duration")).alias("duration_s"),
        to_seconds(named("GC Time")).alias("gc_time_s"),
        *sized("Input"),
        *sized("Shuffle Read"),
        *sized("Shuffle Write"),
    )


def stage_summary(pages: DataFrame) -> DataFrame:
    """Summary metrics of stage detail pages: minimum to maximum per metric, in seconds or bytes."""
    rows = _entries(pages, "stage_detail", F.col("text"), SUMMARY_ENTRY, _stage_of("attempt")).withColumn("c", F.split("entry", "\t"))
    names = ["min", "p25", "median", "p75", "max"]
    values = [in_units(F.get("c", F.lit(i + 1)), TIME_UNITS | BYTE_UNITS).alias(n) for i, n in enumerate(names)]
    return rows.select(
        "case", "path", "app_name", "stage_id", "attempt", F.get("c", F.lit(0)).alias("metric"), *values
    ).where(F.col("median").isNotNull())


def executor_summary(rows: DataFrame) -> DataFrame:
    """Per application: active and dead executors, and the totals of its Total line."""

    def of(state: str, col: str) -> Column:
        return F.max(F.when(F.col("state") == state, F.col(col)))

    return rows.groupBy("case", "app_name").agg(
        of("active", "executors").alias("active"),
        of("dead", "executors").alias("dead"),
        of("total", "executors").alias("total"),
        of("total", "cores").alias("cores"),
        of("total", "failed_tasks").alias("failed_tasks"),
        of("total", "complete_tasks").alias("complete_tasks"),
        of("total", "total_tasks").alias("total_tasks"),
        of("total", "task_time_s").alias("task_time_s"),
        of("total", "gc_time_s").alias("gc_time_s"),
    )


def capture_manifest(pages: DataFrame) -> DataFrame:
    """What was captured: case, file, page kind and title."""
    return classify_pages(pages).select(
        "case",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "page_kind",
        F.col("heading").alias("title"),
        "app_name",
        F.length("text").alias("chars"),
    )
