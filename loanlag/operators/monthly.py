"""Monthly creation cohorts by instalment number (W12).

All periods come out of one aggregation: each fact gets the index of the
month period holding its day, computed arithmetically, so there is neither a
job per month nor a range join against a period table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, month_index, period_bounds
from ..functions.status import percent
from ..presets import DAY_KEYS, DEFAULT_MONTHLY_PERIODS, DEFAULT_MONTHLY_START


def monthly_instalment_cohorts(
    facts: DataFrame,
    start: str | dt.date = DEFAULT_MONTHLY_START,
    periods: int = DEFAULT_MONTHLY_PERIODS,
    day: str = "created_day",
) -> DataFrame:
    """Per month period from ``start`` and instalment number: ``ontime``,
    ``late``, ``never``, ``due_total`` and the never-paid and late
    percentages of the period's due payments.

    Period ``i`` is ``[start + i months, start + (i+1) months)``, same day of
    month; a boundary that does not exist (30 February) raises.
    """
    if day not in DAY_KEYS:
        raise ValueError(f"day must be one of {DAY_KEYS}, not {day!r}")
    bounds = period_bounds(as_date(start), int(periods))
    first, end = bounds[0], bounds[-1]
    d = F.col(day)
    in_span = facts.where((d >= F.lit(first)) & (d < F.lit(end)))
    cohort = F.add_months(F.lit(first), month_index(d, first)).alias("cohort_start")
    counts = (in_span.groupBy(cohort, "multi_payment_number")
              .agg(F.sum("ontime").cast("long").alias("ontime"),
                   F.sum("late").cast("long").alias("late"),
                   F.sum("never").cast("long").alias("never")))
    due = F.col("ontime") + F.col("late")
    return counts.select(
        "cohort_start", "multi_payment_number", "ontime", "late", "never",
        due.alias("due_total"),
        percent("never", due).alias("never_pct"),
        percent("late", due).alias("late_pct"))


def in_cohort_order(report: DataFrame) -> DataFrame:
    """The monthly report sorted by period, then instalment number."""
    return report.orderBy("cohort_start", "multi_payment_number")
