"""Month ends, look-back windows and anchor handling."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def month_end(day: str | dt.date, back: int = 0) -> dt.date:
    """Last day of the month ``back`` months before the month of ``day``."""
    day = as_date(day)
    year, month0 = divmod(day.year * 12 + day.month - 1 - back, 12)
    return dt.date(year, month0 + 1, calendar.monthrange(year, month0 + 1)[1])


def month_ends(anchor: str | dt.date, n: int = 5) -> list[str]:
    """``n`` ISO month ends up to and including the month of ``anchor``, oldest first."""
    return [month_end(anchor, back).isoformat() for back in range(n - 1, -1, -1)]


def feature_date(data_day: str | dt.date) -> str:
    """Month end before the run day; the run day is the day after ``data_day``."""
    return month_end(as_date(data_day) + dt.timedelta(days=1), 1).isoformat()


def clamp_anchor(
    anchor: str, as_of: str, days: int, floor: str | None = None
) -> tuple[str, str]:
    """(first, last) partition to read: ``last`` is never later than the day before ``as_of``.

    The look-back counts from ``as_of``. Both dates are parameters, so a re-run with the
    same arguments reads the same partitions.
    """
    today = as_date(as_of)
    last = min(as_date(anchor), today - dt.timedelta(days=1))
    first = today - dt.timedelta(days=days)
    if floor:
        first = max(first, as_date(floor))
    return first.isoformat(), last.isoformat()


def lit_date(day: str | dt.date) -> Column:
    return F.lit(as_date(day))


def month_end_series(day: Column, n: int = 5) -> Column:
    """Array of the ``n`` month ends up to the month of ``day``, oldest first."""
    return F.array(*[F.last_day(F.add_months(day, -back)) for back in range(n - 1, -1, -1)])


def from_epoch_ms(col: Column) -> Column:
    """Timestamp of an epoch-millisecond value; text that is no number gives null."""
    return F.timestamp_millis(col.try_cast("bigint"))


def days_ago(ts: Column, anchor: str | dt.date) -> Column:
    return F.datediff(lit_date(anchor), ts)


def whole_months_between(later: Column, earlier: Column) -> Column:
    """Months between the month ends of two dates."""
    return F.months_between(F.last_day(later), F.last_day(earlier))


def hour_bucket(ts: Column) -> Column:
    """``[h, h+1)`` of a timestamp; 23 o'clock gives ``[23, 24)``."""
    hour = F.hour(ts)
    return F.concat(F.lit("["), hour.cast("string"), F.lit(", "), (hour + 1).cast("string"), F.lit(")"))
