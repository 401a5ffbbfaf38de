"""Look-back features over columns named ``<month end>_<suffix>``.

``n`` counts months from the anchor month backwards, so ``n = 1`` is the anchor month alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.columns import flag
from creditloom.functions.dates import month_end

FAMILIES = ("ever", "max", "min", "sum", "sum_nullable", "change", "change_ratio")


def month_column(anchor: str, back: int, suffix: str) -> Column:
    return F.col(f"`{month_end(anchor, back).isoformat()}_{suffix}`")


def month_feature(family: str, suffix: str, n: int, anchor: str, months: Sequence[str]) -> Column:
    """One feature.

    ``change`` and ``change_ratio`` compare month n-1 with month n before the anchor, that is
    two neighbouring months. They are 0 when a side is missing, when month n lies outside
    ``months``, and the ratio also when the earlier month is 0. ``sum_nullable`` differs from
    ``sum`` for n = 1 only, where a missing month stays null.
    """
    span = [month_column(anchor, back, suffix) for back in range(n)]
    if family == "ever":
        return flag(reduce(Column.__or__, [F.coalesce(c > 0, F.lit(False)) for c in span]))
    if family == "max":
        return F.greatest(*span) if n > 1 else span[0]
    if family == "min":
        return F.least(*span) if n > 1 else span[0]
    if family == "sum_nullable" and n == 1:
        return span[0]
    if family in ("sum", "sum_nullable"):
        return reduce(Column.__add__, [F.coalesce(c, F.lit(0)) for c in span])
    if family in ("change", "change_ratio"):
        if month_end(anchor, n).isoformat() not in months:
            return F.lit(0)
        newer, older = month_column(anchor, n - 1, suffix), month_column(anchor, n, suffix)
        if family == "change":
            return F.coalesce(newer - older, F.lit(0))
        quotient = F.try_divide(newer.cast("double"), older.cast("double"))
        return F.coalesce(quotient - F.lit(1.0), F.lit(0.0))
    raise ValueError(f"unknown family {family!r}; known: {FAMILIES}")
