"""Date parameters and date expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_timestamp(value: str | dt.date | dt.datetime) -> dt.datetime:
    """Parse an ``as_of`` parameter; a bare date means its midnight."""
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    text = str(value).strip().replace("T", " ")
    try:
        return dt.datetime.fromisoformat(text)
    except ValueError as exc:
        raise ValueError(f"cannot read {value!r} as a timestamp") from exc


def as_date(value: str | dt.date | dt.datetime) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return as_timestamp(value).date()


def next_month_same_day(day: dt.date) -> dt.date:
    """The same day of the following month; raises when it does not exist."""
    year, month = (day.year + 1, 1) if day.month == 12 else (day.year, day.month + 1)
    return dt.date(year, month, day.day)


def period_bounds(start: dt.date, periods: int) -> list[dt.date]:
    """``periods + 1`` consecutive month boundaries from ``start``.

    Validated up front on the driver: a boundary such as 30 February does not
    exist, and the analysis stops on it rather than clamping.
    """
    if periods < 1:
        raise ValueError("periods must be >= 1")
    bounds = [start]
    for _ in range(periods):
        try:
            bounds.append(next_month_same_day(bounds[-1]))
        except ValueError as exc:
            raise ValueError(f"monthly periods from {start}: {exc}") from exc
    return bounds


def month_index(day: Column, start: dt.date) -> Column:
    """Index of the month period ``[start + i months, start + i+1 months)``
    holding ``day`` (negative before ``start``).

    Exact whenever every period boundary exists (see ``period_bounds``).
    """
    months = (F.year(day) * 12 + F.month(day)) - (start.year * 12 + start.month)
    return months - F.when(F.dayofmonth(day) < start.day, 1).otherwise(0)
