"""Predicates, flags, codes and null rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

# Missing-value codes of the feature tables.
NO_VALUE = -999999
ZERO_DENOMINATOR = -999998
NOT_ON_THIS_OS = -999997
NO_CATEGORY = "NULL"


def to_int(col: Column) -> Column:
    """Integer part of numeric text; anything else is null."""
    return col.try_cast("double").try_cast("int")


def ladder(cases: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """First matching case wins."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(default)


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def at_least(col: Column, minimum: float) -> Column:
    return flag(col >= F.lit(minimum))


def classify(cols: Sequence[Column], rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first rule with a pattern contained, ignoring case, in any column."""
    lowered = [F.lower(F.coalesce(c, F.lit(""))) for c in cols]
    cases = [
        (reduce(Column.__or__, [c.contains(p.lower()) for c in lowered for p in patterns]), label)
        for label, patterns in rules
    ]
    return ladder(cases, default)


def map_codes(col: Column, words: Mapping[object, object], default: object = None) -> Column:
    """Word for a code; codes that are not listed give ``default``."""
    return ladder([(col == F.lit(code), word) for code, word in words.items()], default)


def member_flag(col: Column, values: Sequence[object], null_rule: str = "zero") -> Column:
    """1 if the value is listed, else 0; a null value gives 0 (``zero``) or null (``keep``)."""
    hit = col.isin(list(values))
    if null_rule == "keep":
        return F.when(hit, 1).when(col.isNotNull(), 0)
    return flag(hit)


def any_in_list(items: Column, values: Sequence[str], null_rule: str = "zero", lower: bool = True) -> Column:
    """1 if any array item is listed; evaluated inside the row, so nothing is exploded."""
    pick = (lambda x: F.lower(x)) if lower else (lambda x: x)
    hit = F.exists(items, lambda x: F.coalesce(pick(x).isin(list(values)), F.lit(False)))
    if null_rule == "keep":
        known = F.exists(items, lambda x: x.isNotNull())
        return F.when(hit, 1).when(known, 0)
    return flag(F.coalesce(hit, F.lit(False)))


def keep_if_le(value: Column, limit: Column) -> Column:
    """Value where it does not exceed the limit, else null."""
    return F.when(value <= limit, value)


def null_where(condition: Column, value: Column) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), value)


def clamp_start(start: Column, lowest: Column) -> Column:
    return F.when(start <= lowest, lowest).otherwise(start)


def null_count(cols: Sequence[Column]) -> Column:
    return reduce(Column.__add__, [c.isNull().cast("int") for c in cols], F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is null for a zero or missing denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def share(hit: Column, known: Column) -> Column:
    """Aggregate: fraction of rows with ``hit`` among the rows where ``known`` has a value."""
    return F.avg(F.when(hit, 1).when(known.isNotNull(), 0))


def sum_where(condition: Column, value: Column) -> Column:
    """Aggregate: sum over matching rows; 0 where a group has none."""
    return F.sum(F.when(condition, value).otherwise(0))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def exact_sum(col: Column, kind: DataType | None = None, scale: int = 10) -> Column:
    """Aggregate: money sum that does not depend on the order of addition.

    ``kind`` is the column's type: decimals and integers are summed as they are. Other amounts keep
    ``scale`` decimal places and 18 digits before them; one that does not fit, NaN and infinity
    included, ends the query with an error, whatever the session's ANSI setting.
    """
    if isinstance(kind, (DecimalType, IntegralType)):
        return F.sum(col)
    amount = col.try_cast(f"decimal({18 + scale},{scale})")
    lost = col.isNotNull() & amount.isNull()
    return F.sum(F.when(lost, F.raise_error(F.concat(F.lit("amount out of range: "), col.cast("string")))).otherwise(amount))


def log_odds(p: Column) -> Column:
    return F.ln(F.try_divide(p, F.lit(1.0) - p))
