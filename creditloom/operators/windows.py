"""First row per key, daily ranks and top-k.

``row_number() <= k`` is planned with a group limit on both sides of the shuffle: every map
task keeps at most k rows of a key, so a key that holds a large part of the table costs no more
than any other. A rank for *every* row cannot use that limit; see ``rank_per_day``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.columns import ladder, null_count
from creditloom.session import pinned


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. End ``order`` with a unique column to make it repeatable."""
    return top_n(df, keys, order, 1)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key, or of the whole frame without keys."""
    rank = out or "_rank"
    if not keys:
        df = df.orderBy(*order).limit(n)
        if out is None:
            return df
        return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
    return kept if out else kept.drop(rank)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row per key; without an order, a digest of the row decides, the same way on every run."""
    return first_per_key(df, keys, list(order) or [F.xxhash64(*df.columns)])


def latest_complete(df: DataFrame, key: str, ts: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Per key the record of the latest day with the fewest nulls, then the latest time."""
    counted = [F.col(c) for c in (cols or df.columns)]
    order = [F.to_date(ts).desc(), null_count(counted).asc(), F.col(ts).desc()]
    return first_per_key(df, [key], [*order, F.xxhash64(*df.columns)])


def last_entity(df: DataFrame, key: str, age: str, entity: str) -> DataFrame:
    """Entity with the smallest age per key; the smaller entity id wins a tie, a missing age or id comes last."""
    order = [F.col(age).asc_nulls_last(), F.col(entity).asc_nulls_last()]
    return first_per_key(df.select(key, entity, age), [key], order)


def common_entity(df: DataFrame, key: str, entity: str) -> DataFrame:
    """Entity with most rows per key; the smaller entity id wins a tie."""
    counts = df.groupBy(key, entity).agg(F.count(F.lit(1)).alias("n"))
    return first_per_key(counts, [key], [F.desc("n"), F.col(entity).asc_nulls_last()]).select(key, entity)


def latest_as_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], at: Column, anchor: Column) -> DataFrame:
    """Latest row per key among those at or before the anchor."""
    return first_per_key(df.where(at <= anchor), keys, order)


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, cols: Sequence[str],
    ties: Sequence[str] = (),
) -> DataFrame:
    """Every left row with ``cols`` of the key's last right row at or before the row's own time.

    Both sides are put in one order of key and time and cut into ranges, so a key of any size is
    spread over as many parts as its rows fill. Within a part the last known right row is carried on;
    what a part starts with is the last right row of the key in the parts before it, and there is one
    such row per key and part. No row meets more than one other, whatever the number of right rows.

    Right rows of one time: the last in the order of ``ties``, then of a digest. Left rows without a
    key or a time, or before any right row, get nulls; right rows without them match nothing. The
    order is materialised when this is called, because both steps must use the same parts.
    """
    keys = list(keys)
    rest = [c for c in left.columns if c not in keys]
    usable = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    record = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*[F.col(c) for c in ties], F.xxhash64(*cols))
    ours = left.select(
        *keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*rest).alias("_left"),
        F.xxhash64(*left.columns).alias("_digest"),
    )
    theirs = right.where(usable & F.col(right_at).isNotNull()).select(
        *keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), rank.alias("_rank"), record.alias("_right"),
    )
    both = ours.unionByName(theirs, allowMissingColumns=True)
    order = [F.col(c) for c in ("_at", "_side", "_rank", "_digest")]
    placed = pinned(both.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # The last right row of each key and part, and of the parts before.
    ends = top_n(placed.where("_side = 0"), [*keys, "_part"], [c.desc() for c in order], 1).select(*keys, "_part", "_right")
    parts = placed.where(usable).select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left")
    carried = parts.withColumn("_carried", F.last("_right", ignorenulls=True).over(before)).drop("_right")
    seen = F.last("_right", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = placed.withColumn("_seen", seen).where("_side = 1").join(carried, [*keys, "_part"], "left")
    best = F.when(usable & F.col("_at").isNotNull(), F.coalesce("_seen", "_carried"))
    out = found.withColumn("_best", best)
    picked = [F.col(c) if c in keys else F.col("_left")[c].alias(c) for c in left.columns]
    return out.select(*picked, *[F.col("_best")[c].alias(c) for c in cols])


def running_total(df: DataFrame, keys: Sequence[str], at: str, amount: str, out: str) -> DataFrame:
    """Every row with the sum of the amounts of its key up to it; ``at`` is unique within a key.

    Rows are range-sorted by key and ``at`` into as many parts as a shuffle has; a row's total is that
    of its part up to it and the sums of its key's parts before, one number per key and part. A key of
    any size is spread over the parts it fills. The order is materialised when this is called.
    """
    placed = pinned(df.repartitionByRange(*keys, at).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"_at_{k}" for k in [*keys, "_part"]}
    parts = placed.groupBy(*keys, "_part").agg(F.sum(amount).alias("_sum"))
    carried = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").withColumnsRenamed(named)
    here = placed.withColumn("_here", F.sum(amount).over(Window.partitionBy(*keys, "_part").orderBy(at)))
    joined = here.join(carried, [F.col(k).eqNullSafe(F.col(c)) for k, c in named.items()])
    return joined.select(*df.columns, (F.col("_before") + F.col("_here")).alias(out))


def valid_counts(df: DataFrame, keys: Sequence[str], start: str, end: str, day: str = "day", out: str = "valid") -> DataFrame:
    """How many half-open intervals ``[start, end)`` of a key are valid from each day on that changes it.

    An interval is a rise at its start and a fall at its end, added up per key and day before they are
    summed in order: rows follow intervals and never the days between. Empty intervals and those
    without an end or a start count for nothing; days whose rises and falls cancel stay.
    """
    rise = F.struct(F.col(start).alias(day), F.lit(1).alias("_step"))
    fall = F.struct(F.col(end).alias(day), F.lit(-1).alias("_step"))
    events = df.where(F.col(start) < F.col(end)).select(*keys, F.inline(F.array(rise, fall)))
    changes = events.groupBy(*keys, day).agg(F.sum("_step").alias("_step"))
    return running_total(changes, keys, day, "_step", out).drop("_step")


def latest_snapshot(df: DataFrame, key: str, day: str, item: str) -> DataFrame:
    """Distinct items of each key on the key's latest day.

    Two aggregates instead of a window over whole keys: an item belongs to the latest snapshot
    when its own last day is the last day of its key. ``day`` should be a date: the maximum of a
    string column cannot be hash-aggregated.
    """
    from creditloom.operators.joins import with_group_value

    last_seen = df.groupBy(key, item).agg(F.max(day).alias(day))
    marked = with_group_value(last_seen, [key], F.max(day), "_latest")
    return marked.where(F.col(day) == F.col("_latest")).drop("_latest")


def queue_class(queue: Column, marks: Sequence[str]) -> Column:
    """1 when the queue name contains one of the marks, ignoring case."""
    lowered = F.lower(F.coalesce(queue, F.lit("")))
    return ladder([(lowered.contains(m), 1) for m in marks], 0)


def metric_order(metric: Column, tie: Column) -> list[Column]:
    """Largest metric first, a missing one counting as 0; ties in the order of an id digest."""
    text = tie.cast("string")
    return [F.coalesce(metric, F.lit(0)).desc(), F.md5(text).asc(), text.asc()]


def rank_per_day(
    df: DataFrame,
    day: str,
    metric: str,
    tie: str,
    cls: Column | None = None,
    top: int | None = None,
    out: str = "rank",
) -> DataFrame:
    """Rank of each row within its day (and class) by a metric; ``tie`` must be unique in a day.

    With ``top`` only the first rows are kept and the group limit applies. Without it every row is
    ranked exactly, yet no task receives a whole day: the rows are range-sorted by day, metric and
    id digest into as many parts as a shuffle has, the days' rows are counted per part, and a row's
    rank is the number of its day's rows in earlier parts plus its position in its own. The sort is
    materialised when this is called, because counting and numbering must use the same parts.
    """
    group = "_cls"
    rows = df.withColumn(group, cls if cls is not None else F.lit(0))
    order = metric_order(F.col(metric), F.col(tie))
    if top is not None:
        return top_n(rows, [day, group], order, top, out).drop(group)

    keys = [day, group, "_part"]
    placed = pinned(rows.repartitionByRange(F.col(day), F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(day, group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A part holds the end of one day, whole days and the start of another, so this is small.
    offsets = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    at = {k: f"_at_{k}" for k in keys}
    offsets = offsets.withColumnsRenamed(at)
    # Null-safe, so that rows without a day are ranked among themselves.
    numbered = placed.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).join(
        offsets, [F.col(k).eqNullSafe(F.col(c)) for k, c in at.items()]
    )
    return numbered.select(*df.columns, (F.col("_before") + F.col("_pos")).cast("int").alias(out))


def top_ranked(
    df: DataFrame, day: str, carry: Sequence[str], metrics: Mapping[str, tuple[str, Column | None]], k: int, tie: str
) -> DataFrame:
    """(day, metric name, rank, carried columns) of the first ``k`` rows per day and metric.

    ``metrics`` maps a name to (metric column, condition that rows must meet or None). Metrics of
    one type are ranked in one pass over the rows and compared in that type; the result has at most
    k rows per day and metric whatever the size of the input. The smaller ``tie`` wins a tie.
    """
    by_type: dict[str, dict[str, tuple[str, Column | None]]] = {}
    for name, (col, condition) in metrics.items():
        by_type.setdefault(df.schema[col].dataType.simpleString(), {})[name] = (col, condition)
    tops = [_top_of_one_type(df, day, carry, alike, k, tie) for alike in by_type.values()]
    return reduce(DataFrame.unionByName, tops)


def _top_of_one_type(
    df: DataFrame, day: str, carry: Sequence[str], metrics: Mapping[str, tuple[str, Column | None]], k: int, tie: str
) -> DataFrame:
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            (F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))).alias("counts"),
            F.coalesce(F.col(col), F.lit(0)).alias("value"),
        )
        for name, (col, condition) in metrics.items()
    ]
    long = df.select(day, tie, *carry, F.inline(F.array(*entries))).where("counts")
    order = [F.col("value").desc(), F.col(tie).asc()]
    return top_n(long, [day, "metric"], order, k, "rank").select(day, "metric", "rank", tie, *carry)


def daily_top_flags(
    df: DataFrame, day: str, tie: str, metrics: Mapping[str, tuple[str, Column | None]], ks: Sequence[int]
) -> DataFrame:
    """Every row with one 0/1 column ``<metric>_top<k>`` per metric and k."""
    top = top_ranked(df, day, [], metrics, max(ks), tie)
    names = {f"{m}_top{k}": (m, k) for m in metrics for k in ks}
    flags = top.groupBy(day, tie).agg(
        *[
            F.max(F.when((F.col("metric") == m) & (F.col("rank") <= k), 1).otherwise(0)).alias(n)
            for n, (m, k) in names.items()
        ]
    )
    return df.join(flags, [day, tie], "left").select(
        *df.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]
    )
