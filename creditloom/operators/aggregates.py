"""Roll-ups, month columns, distinct counts and streaks; all combine before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.columns import ZERO_DENOMINATOR
from creditloom.functions.dates import lit_date


def month_rollup(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    aggs: Sequence[Column],
    out: str = "month",
    where: Column | None = None,
) -> DataFrame:
    """Aggregate daily rows per key and month end."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys, F.last_day(F.col(day)).alias(out)).agg(*aggs)


def month_agg(kind: str, col: Column, in_month: Column) -> Column:
    """Aggregate of one month's rows; null, also for counts, when the month has no rows."""
    value = F.when(in_month, col)
    if kind == "count":
        return F.when(F.count(F.when(in_month, 1)) > 0, F.count(value))
    return {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}[kind](value)


def pivot_months(
    df: DataFrame, keys: Sequence[str], month: str, months: Sequence[str], aggs: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """One row per key with columns ``<month>_<alias>`` for the given months.

    ``aggs`` maps an alias to (sum|count|max|min|avg, column). Conditional aggregates shuffle
    once; a pivot would first shuffle by key and month.
    """
    return df.groupBy(*keys).agg(
        *[
            month_agg(kind, col, F.col(month) == lit_date(m)).alias(f"{m}_{alias}")
            for m in months
            for alias, (kind, col) in aggs.items()
        ]
    )


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


def group_count(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def first_month(df: DataFrame, key: str, day: str, out: str = "first_month") -> DataFrame:
    return df.groupBy(key).agg(F.min(F.last_day(F.col(day))).alias(out))


def activity_span(df: DataFrame, key: str, age: str, out: str = "span") -> DataFrame:
    """Days between the oldest and the latest activity of a key."""
    return df.groupBy(key).agg((F.max(age) - F.min(age)).alias(out))


def entity_windows(df: DataFrame, key: str, entity: str, age: str, windows: Sequence[int]) -> DataFrame:
    """Per (key, entity): smallest and largest age, and rows younger than each window."""
    return df.groupBy(key, entity).agg(
        F.min(age).alias("youngest"),
        F.max(age).alias("oldest"),
        *[F.count_if(F.col(age) < w).alias(f"rows_{w}") for w in windows],
    )


def window_totals(windows: Sequence[int], prefix: str, empty: int = ZERO_DENOMINATOR) -> list[Column]:
    """Aggregates over ``entity_windows``: distinct entities per window, alone and per row."""
    counts = {w: F.count_if(F.col("youngest") < w) for w in windows}
    norm = {
        w: F.coalesce(F.try_divide(counts[w].cast("double"), F.sum(f"rows_{w}")), F.lit(float(empty))) for w in windows
    }
    return [
        *[counts[w].alias(f"{prefix}_{w}d") for w in windows],
        *[norm[w].alias(f"{prefix}_norm_{w}d") for w in windows],
    ]


def distinct_per_window(
    df: DataFrame,
    key: str,
    entity: str,
    age: str,
    windows: Sequence[int] = (30, 90, 180, 360),
    empty: int = ZERO_DENOMINATOR,
    prefix: str = "distinct_device_cnt",
) -> DataFrame:
    """Distinct entities per look-back window, and their number per row of the window.

    An entity counts in a window when its smallest age does, so one pass over (key, entity)
    serves all windows and no row is repeated per window.
    """
    return entity_windows(df, key, entity, age, windows).groupBy(key).agg(*window_totals(windows, prefix, empty))


def tag_counts(df: DataFrame, key: str, tag: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(tag).alias(out))


def with_row_count(df: DataFrame, count_of: DataFrame, out: str) -> DataFrame:
    """Number of rows of ``count_of`` on every row, without an action in the middle of the plan."""
    total = count_of.agg(F.count(F.lit(1)).alias(out))
    return df.crossJoin(F.broadcast(total))


def rollup_flags(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(f).alias(f) for f in flags])


def streak(df: DataFrame, name: str, day: str, flags: Sequence[str], days: int) -> DataFrame:
    """1 per flag when a name occurs on ``days`` days and the flag is set on every one of them."""
    daily = rollup_flags(df, [name, day], flags)
    every_day = F.count(day) == days
    return daily.groupBy(name).agg(
        *[F.when(every_day & (F.sum(f) == days), 1).otherwise(0).alias(f) for f in flags]
    )
