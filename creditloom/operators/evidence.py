"""Run evidence: task distributions, size rules, hot keys, inflation, repeated scans, comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from creditloom.functions.columns import flag, ratio
from creditloom.operators.windows import top_n
from creditloom.session import pinned

# Limits from which a stage counts as huge, and how many of them call for a table in between.
HUGE_ROWS = 1_000_000_000
HUGE_BYTES = 2 * 1024**4
HUGE_SECONDS = 30 * 60
HUGE_STAGES = 4

# Mean file size below which files count as small.
SMALL_FILE_BYTES = 16 * 1024**2


def table_profile(files: DataFrame, part: str, lo: str, hi: str) -> DataFrame:
    """Partitions, rows, files and bytes of a table, and rows within a partition window.

    ``files`` are the rows of ``sources.footers.file_footers`` with the partition value as ``part``:
    what a file holds is read from its footer, so no data is scanned.
    """
    inside = (F.col(part) >= lo) & (F.col(part) <= hi)
    per_part = files.groupBy(part).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("n"), F.sum("bytes").alias("bytes"))
    zero = F.lit(0).cast("bigint")
    return per_part.agg(
        F.count(part).alias("partitions"),
        F.count_if(inside).alias("window_partitions"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), zero).alias("window_rows"),
        F.coalesce(F.sum("n"), zero).alias("total_rows"),
        F.coalesce(F.sum("files"), zero).alias("files"),
        F.coalesce(F.sum("bytes"), zero).alias("total_bytes"),
    )


def scanned_profile(df: DataFrame, part: str, lo: str, hi: str) -> DataFrame:
    """The row counts of ``table_profile`` for a frame that is not stored as Parquet files."""
    per_part = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col(part) >= lo) & (F.col(part) <= hi)
    return per_part.agg(
        F.count(part).alias("partitions"),
        F.count_if(inside).alias("window_partitions"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("window_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
    )


def partition_rows(df: DataFrame, part: str) -> DataFrame:
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"))


def small_files(files: DataFrame, by: Sequence[str] = ("folder",), limit: int = SMALL_FILE_BYTES) -> DataFrame:
    """Files, bytes and mean size per folder; 1 where there are several files and their mean is small."""
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("total_bytes"), F.avg("bytes").alias("mean_bytes")
    ).withColumn("small_files", flag((F.col("files") > 1) & (F.col("mean_bytes") < limit)))


def exact_percentiles(rows: DataFrame, by: Sequence[str], metric: str, cuts: Mapping[str, float]) -> DataFrame:
    """Per group: count, min, max and the percentiles of a metric, exact for groups of any size.

    A percentile is the first value with at least that share of the group's values at or before it.
    Equal values are counted before anything moves. The counts are range-sorted by group and value
    into as many parts as a shuffle has, so a group is spread over the parts it fills; its running
    count in a part starts with the sum of its parts before, one number per group and part. Nulls
    count for nothing; a group of nulls has 0 and nulls. The sorted counts are materialised when this
    is called, because sums and running counts must use the same parts.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    named = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(metric).alias("_v"))
    counts = named.groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    placed = pinned(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(k).alias(f"{k}o") for k in keys], F.col("_part").alias("_parto"),
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(group).alias("_all"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"{k}o")) for k in keys] + [F.col("_part") == F.col("_parto")]
    running = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    upto = placed.withColumn("_here", running).join(offsets, same).withColumn("_upto", F.col("_before") + F.col("_here"))

    def at(cut: float) -> Column:
        rank = F.greatest(F.ceil(F.lit(cut) * F.col("_all")), F.lit(1))
        return F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("_v"))

    found = upto.groupBy(*keys).agg(
        F.sum("_n").alias("count"), F.min("_v").alias("min"), *[F.min(at(c)).alias(n) for n, c in cuts.items()], F.max("_v").alias("max")
    )
    return found.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def task_distribution(tasks: DataFrame, by: Sequence[str], metric: str, tail: float = 3.0) -> DataFrame:
    """Spread of a task metric per stage, and whether its end is a tail or the whole stage is heavy."""
    cuts = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    out = exact_percentiles(tasks, by, metric, cuts).withColumnRenamed("count", "tasks")
    spread = ratio(F.col("max"), F.col("median"))
    return out.withColumn("max_to_median", spread).withColumn(
        "shape", F.when(F.col("max_to_median") >= tail, "long_tail").otherwise("volume")
    )


def size_findings(
    stages: DataFrame, by: Sequence[str], rows: str, size: str, seconds: str,
    max_rows: float = HUGE_ROWS, max_bytes: float = HUGE_BYTES, max_seconds: float = HUGE_SECONDS, many: int = HUGE_STAGES,
) -> DataFrame:
    """Stages over each limit per run, and whether there are so many that a part should be stored."""
    big, slow = (F.col(rows) > max_rows) | (F.col(size) > max_bytes), F.col(seconds) > max_seconds
    return stages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("stages"),
        F.count_if(F.col(rows) > max_rows).alias("over_rows"),
        F.count_if(F.col(size) > max_bytes).alias("over_bytes"),
        F.count_if(slow).alias("over_time"),
        F.count_if(F.coalesce(big, F.lit(False)) | F.coalesce(slow, F.lit(False))).alias("huge"),
    ).withColumn("materialise", flag(F.col("huge") > many))


def _frequent_items(key: str, size: int):
    """Counts of a task's most frequent values: at most ``size``, each too low by at most the task's loss.

    When more values are held, the count of the first one too many is taken from all, and those
    without any left are let go; a value that is held or not has then lost at most that. The row
    without a value has the task's loss.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        lost = 0
        for batch in batches:
            column = batch.column(0).drop_null()
            found = column.value_counts()
            table = pa.table({key: found.field("values"), "n": found.field("counts").cast(pa.int64())})
            held = table if held is None else pa.concat_tables([held, table]).group_by(key).aggregate([("n", "sum")]).rename_columns([key, "n"])
            if held.num_rows > size:
                held = held.sort_by([("n", "descending")])
                cut = held.column("n")[size].as_py()
                lost += cut
                left = pc.subtract(held.column("n"), cut)
                held = held.set_column(1, "n", left).filter(pc.greater(left, 0))
        if held is None:
            return
        held = held.append_column("lost", pa.array([0] * held.num_rows, pa.int64()))
        yield from held.combine_chunks().to_batches()
        empty = pa.nulls(1, held.schema.field(key).type)
        yield pa.RecordBatch.from_arrays([empty, pa.array([0], pa.int64()), pa.array([lost], pa.int64())], [key, "n", "lost"])

    return sketch


def frequent_items(df: DataFrame, key: str, size: int = 4096) -> DataFrame:
    """Mergeable sketch of the frequent values of a column: value, n, lost.

    A value's true count is at least the sum of its ``n`` and exceeds it by at most the sum of
    ``lost``, which is at most rows / size. A task gives at most ``size`` rows and one with its loss.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(key).mapInArrow(_frequent_items(key, size), f"`{key}` {kind}, n long, lost long")


def distinct_count(df: DataFrame, key: str) -> DataFrame:
    """How many values other than null a column has, as ``keys``, exactly.

    Whole numbers are bits of bitmaps, 4 KB for a range of 32,768 of them, or-ed per range: as many
    rows are shuffled as there are ranges in use. Other types are made distinct.
    """
    if not isinstance(df.schema[key].dataType, IntegralType):
        return df.where(F.col(key).isNotNull()).select(key).distinct().agg(F.count(F.lit(1)).alias("keys"))
    value = F.col(key).cast("bigint")
    bits = df.where(value.isNotNull()).groupBy(F.bitmap_bucket_number(value).alias("_range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("_bits")
    )
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0).cast("bigint")).alias("keys"))


def hot_keys(df: DataFrame, key: str, n: int = 10, size: int = 4096) -> DataFrame:
    """The most frequent keys with their share of all rows and their multiple of the mean, exactly.

    A sketch of ``size`` keys per task names the candidates, and only their rows are counted again:
    what is shuffled is bounded by the sketch and not by the number of keys. Where the sketch cannot
    rule out that another key is as frequent, or leaves more candidates than it has room for, because
    no key stands out, all keys are counted. A missing key is a key like any other. The sketch is
    made when this is called.
    """
    merged = frequent_items(df, key, size).groupBy(key).agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    merged = pinned(merged)
    lost = merged.agg(F.sum("lost")).first()[0] or 0
    top = [r[0] for r in merged.where(F.col(key).isNotNull()).orderBy(F.desc("n")).limit(n).select("n").collect()]
    # A key that the sketch lets go has at most ``lost`` rows, fewer than each of the first n.
    counted = df
    if len(top) == n and top[-1] > lost > 0:
        chosen = merged.where(F.col(key).isNotNull() & (F.col("n") + lost >= top[-1])).select(key)
        if chosen.count() <= size:
            listed = F.broadcast(chosen.withColumn("_chosen", F.lit(True)))
            counted = df.join(listed, key, "left").where(F.col("_chosen") | F.col(key).isNull())
    counts = counted.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    without = F.max(F.col(key).isNull()).cast("bigint")
    totals = df.agg(F.count(F.lit(1)).alias("_all"), F.coalesce(without, F.lit(0)).alias("_missing"))
    totals = totals.crossJoin(F.broadcast(distinct_count(df, key)))
    first = top_n(counts, [], [F.desc("n_rows"), F.col(key).asc_nulls_last()], n)
    return first.crossJoin(F.broadcast(totals)).select(
        key,
        "n_rows",
        ratio(F.col("n_rows"), F.col("_all")).alias("share"),
        (ratio(F.col("n_rows"), F.col("_all")) * (F.col("keys") + F.col("_missing"))).alias("times_mean"),
    )


def row_inflation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows per key before and after a step, and their quotient."""
    old = before.groupBy(key).agg(F.count(F.lit(1)).alias("rows_before"))
    new = after.groupBy(key).agg(F.count(F.lit(1)).alias("rows_after"))
    zero = F.lit(0).cast("bigint")
    return old.join(new, key, "full").select(
        key,
        F.coalesce("rows_before", zero).alias("rows_before"),
        F.coalesce("rows_after", zero).alias("rows_after"),
    ).withColumn("inflation", ratio(F.col("rows_after"), F.col("rows_before")))


def repeated_scans(run_inputs: DataFrame, table: str, part: str, run: str, size: str | None = None) -> DataFrame:
    """Table partitions that more than one run has read."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("runs")]
    per_run_aggs: list[Column] = [F.count(F.lit(1)).alias("reads")]
    if size:
        per_run_aggs.append(F.sum(size).alias("_size"))
        aggs.append(F.sum("_size").alias("read_total"))
    per_run = run_inputs.groupBy(table, part, run).agg(*per_run_aggs)
    aggs.append(F.sum("reads").alias("reads"))
    return per_run.groupBy(table, part).agg(*aggs).where(F.col("runs") > 1)


def compare_runs(before: DataFrame, after: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Metrics of two runs side by side with absolute and relative change."""
    old = before.select(metric, F.col(value).alias("before"))
    new = after.select(metric, F.col(value).alias("after"))
    return old.join(new, metric, "full").withColumns(
        {
            "change": F.col("after") - F.col("before"),
            "change_pct": F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100,
        }
    )


def rank_findings(
    findings: DataFrame, case: str = "case", cause: str = "cause", impact: str = "impact", risk: str = "risk",
    confirmed: str = "confirmed", n: int = 5,
) -> DataFrame:
    """Top causes per case: findings that share a cause count once, by impact, then lowest risk."""
    causes = findings.groupBy(case, cause).agg(
        F.max(impact).alias("impact"),
        F.min(risk).alias("risk"),
        F.count(F.lit(1)).alias("findings"),
        F.max(F.col(confirmed).cast("int")).alias("_ok"),
    )
    order = [F.desc("impact"), F.asc("risk"), F.asc(cause)]
    ranked = top_n(causes, [case], order, n, "rank")
    return ranked.withColumn("status", F.when(F.col("_ok") == 1, "confirmed").otherwise("to confirm")).drop("_ok")
