"""Column-level operators on a frame; none of them moves rows between tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.columns import NO_CATEGORY, NO_VALUE, at_least, member_flag
from creditloom.functions.dates import as_date, days_ago


def sum_columns(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Sum of columns; null when any part is null."""
    return df.withColumn(out, reduce(Column.__add__, [F.col(c) for c in cols]))


def threshold_flags(
    df: DataFrame, col: str, minimums: Mapping[str, float], always: Sequence[str] = ()
) -> DataFrame:
    """One 0/1 column per threshold; ``always`` names columns that are 1 on every row."""
    flags = {name: F.lit(1) for name in always}
    flags.update({name: at_least(F.col(col), low) for name, low in minimums.items()})
    return df.withColumns(flags)


def require_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose keys are not null and, where they are strings, not empty."""
    tests = []
    for c in cols:
        present = F.col(c).isNotNull()
        tests.append(present & (F.col(c) != "") if isinstance(df.schema[c].dataType, T.StringType) else present)
    return df.where(reduce(Column.__and__, tests))


def days_ago_window(
    df: DataFrame, ts: Column, anchor: str, days: int, lo: int = 0, out: str = "days_ago", part: str | None = None
) -> DataFrame:
    """Rows with ``lo <= days since ts < days``, with that number as a column.

    A filter on the event time alone cannot prune partitions. When ``part`` names an ISO date
    partition column that is never earlier than the event day, the matching bound is added.
    """
    age = days_ago(ts, anchor)
    kept = df.where((age >= lo) & (age < days)).withColumn(out, age)
    if part is None:
        return kept
    oldest = F.date_format(F.date_sub(F.lit(as_date(anchor)), days - 1), "yyyy-MM-dd")
    return kept.where(F.col(part) >= oldest)


def membership_flags(
    df: DataFrame, col: str, lists: Mapping[str, Sequence[object]], null_rule: str = "zero"
) -> DataFrame:
    return df.withColumns({name: member_flag(F.col(col), values, null_rule) for name, values in lists.items()})


def add_prefix(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """Keys first, then the other columns in name order as ``prefix_name``."""
    rest = sorted(set(df.columns) - set(keys))
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in rest])


def add_suffix(df: DataFrame, starts_with: str, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix) if c.startswith(starts_with) else F.col(c) for c in df.columns])


def fill_sentinels(
    df: DataFrame, number: float | None = NO_VALUE, text: str | None = NO_CATEGORY, cols: Sequence[str] | None = None
) -> DataFrame:
    """Replace nulls by kind of column: ``number`` in numeric ones, ``text`` in string ones."""
    wanted = set(cols if cols is not None else df.columns)
    fills: dict[str, object] = {}
    for field in df.schema.fields:
        if field.name not in wanted:
            continue
        if isinstance(field.dataType, T.NumericType) and number is not None:
            fills[field.name] = number
        elif isinstance(field.dataType, T.StringType) and text is not None:
            fills[field.name] = text
    return df.fillna(fills) if fills else df


def select_ordered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])


def with_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def align_columns(
    a: DataFrame, b: DataFrame, fill: object, overrides: Mapping[str, object] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Give both frames the same columns in the same order.

    A missing column gets its value from ``overrides``, else ``fill``. Where the types of a
    shared column differ and one is a string, both become strings.
    """
    overrides = dict(overrides or {})
    types_a = {f.name: f.dataType for f in a.schema.fields}
    types_b = {f.name: f.dataType for f in b.schema.fields}
    order = list(types_b) + [c for c in types_a if c not in types_b]

    def column(own: dict, other: dict, name: str) -> Column:
        kind, kind_other = own.get(name), other.get(name)
        if kind is None:
            value = F.lit(overrides.get(name, fill))
            return value.cast(kind_other).alias(name)
        mixed = kind_other is not None and kind != kind_other
        if mixed and T.StringType() in (kind, kind_other):
            return F.col(name).cast("string").alias(name)
        return F.col(name)

    return (
        a.select(*[column(types_a, types_b, c) for c in order]),
        b.select(*[column(types_b, types_a, c) for c in order]),
    )


def union_aligned(
    a: DataFrame, b: DataFrame, fill: object, overrides: Mapping[str, object] | None = None
) -> DataFrame:
    """Union of two populations with different columns."""
    left, right = align_columns(a, b, fill, overrides)
    return left.unionByName(right)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
