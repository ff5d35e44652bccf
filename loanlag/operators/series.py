"""Daily counts (W8) and trailing late-payment ratios (W9-W11, W13).

Only ``daily_counts`` touches fact rows.  The trailing window runs over its
output, at most one row per calendar day and group, and is partitioned by
blocks of days, so its tasks stay small and parallel however long the series.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..functions.status import percent
from ..functions.values import column_in_values
from ..presets import DAY_KEYS, DEFAULT_DAY_KEY, DEFAULT_GROUP, DEFAULT_WINDOW_DAYS
from .eligibility import due_payments
from .facts import payment_status


def _check_day(day: str) -> None:
    if day not in DAY_KEYS:
        raise ValueError(f"day must be one of {DAY_KEYS}, not {day!r}")


def daily_counts(facts: DataFrame, day: str = DEFAULT_DAY_KEY, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` and day: summed ``ontime``, ``late``, ``never`` and the
    day's on-time percentage ``ontime_pct``.

    ``facts`` may be detail rows (0/1 flags) or pre-summed counts.
    """
    _check_day(day)
    return (facts.groupBy(*by, F.col(day).alias("day"))
            .agg(F.sum("ontime").cast("long").alias("ontime"),
                 F.sum("late").cast("long").alias("late"),
                 F.sum("never").cast("long").alias("never"))
            .withColumn("ontime_pct", percent("ontime", F.col("ontime") + F.col("late"))))


# Days per window partition.  Each partition holds at most this many days
# (per group) plus the ``days - 1`` days before them.
BLOCK_DAYS = 366


def trailing_late_ratio(
    daily: DataFrame,
    days: int = DEFAULT_WINDOW_DAYS,
    by: Sequence[str] = (),
    as_of: str | dt.date | dt.datetime | None = None,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Trailing ``days``-calendar-day totals for every day present in ``daily``.

    The window of day ``d`` is ``(d - days, d]``: a range over the calendar,
    so days without data neither produce output nor count towards the
    ``days``.  Output: ``[by], day, late_pct, due_total, late_total,
    never_total``.  Days after ``as_of`` and null days are dropped first.

    The calendar is cut into blocks of ``block_days`` (at least ``days``) and
    the window is partitioned by block as well as ``by``, so no task holds the
    whole series.  A day is also copied, as a halo row, into the following
    block when that block's windows reach back to it; halo rows feed the sums
    but are not output, so every day's totals are exact.
    """
    days = int(days)
    if days < 1:
        raise ValueError("days must be >= 1")
    keep = F.col("day").isNotNull()
    if as_of is not None:
        keep = keep & (F.col("day") <= F.lit(as_date(as_of)))
    span = max(int(block_days), days)
    day_no = F.unix_date("day")
    home = F.floor(day_no / span)
    reach = F.floor((day_no + (days - 1)) / span)
    blocked = daily.where(keep).select(
        *by, "day", "ontime", "late", "never",
        home.alias("_home"), F.explode(F.sequence(home, reach)).alias("_block"))
    w = (Window.partitionBy(*by, "_block").orderBy(day_no)
         .rangeBetween(-(days - 1), Window.currentRow))
    sums = blocked.select(*by, "day", "_home", "_block",
                          *(F.sum(c).over(w).alias(f"_{c}") for c in ("ontime", "late", "never")))
    on, late = F.col("_ontime"), F.col("_late")
    return (sums.where(F.col("_block") == F.col("_home"))
            .select(*by, "day",
                    percent(late, late + on).alias("late_pct"),
                    (late + on).alias("due_total"),
                    late.alias("late_total"),
                    F.col("_never").alias("never_total")))


def _until(facts: DataFrame, day: str, as_of) -> DataFrame:
    # Filtering facts (not the daily table) lets Catalyst push the bound
    # below the joins, into the loans or payments scan.
    if as_of is None:
        return facts
    return facts.where(F.col(day) <= F.lit(as_date(as_of)))


def late_ratio(
    facts: DataFrame,
    day: str = DEFAULT_DAY_KEY,
    days: int = DEFAULT_WINDOW_DAYS,
    as_of: str | dt.date | dt.datetime | None = None,
) -> DataFrame:
    """Overall trailing late ratio by creation day or by due day (W10)."""
    _check_day(day)
    return trailing_late_ratio(daily_counts(_until(facts, day, as_of), day), days, as_of=as_of)


def group_late_ratio(
    facts: DataFrame,
    values: Iterable = DEFAULT_GROUP,
    include_rest: bool = True,
    day: str = DEFAULT_DAY_KEY,
    days: int = DEFAULT_WINDOW_DAYS,
    as_of: str | dt.date | dt.datetime | None = None,
    column: str = "country",
) -> DataFrame:
    """Trailing late ratio for the rows whose ``column`` is in ``values``
    (``in_group`` true) and, with ``include_rest``, for all other rows
    (``in_group`` false, null values included) (W11).

    One aggregation and one windowed pass serve both series.
    """
    _check_day(day)
    flagged = facts.withColumn("in_group", column_in_values(facts, column, values))
    if not include_rest:
        flagged = flagged.where(F.col("in_group"))
    daily = daily_counts(_until(flagged, day, as_of), day, by=["in_group"])
    return trailing_late_ratio(daily, days, by=["in_group"], as_of=as_of)


def all_payments_daily(payments: DataFrame, as_of: str | dt.date | dt.datetime) -> DataFrame:
    """Daily counts by due day over every due payment, no loan filters."""
    return daily_counts(payment_status(due_payments(payments, as_of)), "dtpayment")


def all_payments_late_ratio(
    payments: DataFrame,
    as_of: str | dt.date | dt.datetime,
    days: int = DEFAULT_WINDOW_DAYS,
) -> DataFrame:
    """Trailing late ratio over every due payment, by due day (W13)."""
    return trailing_late_ratio(all_payments_daily(payments, as_of), days, as_of=as_of)


def in_day_order(series: DataFrame) -> DataFrame:
    """A daily or trailing series sorted for output: by its groups, then day.

    Apply last: a global sort is a range shuffle, cheap on a calendar-bounded
    series, wasteful anywhere below another operator.
    """
    by = [c for c in series.columns if c == "in_group"]
    return series.orderBy(*by, "day")
