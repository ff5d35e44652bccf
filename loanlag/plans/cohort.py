"""Cohort pipelines: trailing late ratios (total and by group) and the
monthly instalment report, each built as one lazy plan from the five tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, period_bounds
from ..functions.status import percent
from ..functions.values import column_in_values
from ..operators.facts import payment_facts
from ..operators.monthly import monthly_instalment_cohorts
from ..operators.series import daily_counts, trailing_late_ratio
from ..presets import (DAY_KEYS, DEFAULT_DAY_KEY, DEFAULT_GROUP, DEFAULT_MONTHLY_PERIODS,
                       DEFAULT_MONTHLY_START, DEFAULT_WINDOW_DAYS, THIRTY_DAY_PAYMENT_TYPES)
from ..session import checkpoint_dir
from ..sources.readers import LoanTables


@dataclass(frozen=True)
class CohortSeries:
    """``total``: overall series; ``by_group``: group (and rest) series;
    ``daily``: the per-(in_group, day) counts both are windowed from."""

    total: DataFrame
    by_group: DataFrame
    daily: DataFrame


def cohort_late_ratios(
    tables: LoanTables,
    as_of: str | dt.date | dt.datetime,
    day: str = DEFAULT_DAY_KEY,
    days: int = DEFAULT_WINDOW_DAYS,
    values: Iterable = DEFAULT_GROUP,
    include_rest: bool = True,
    payment_types: Iterable[int] | None = THIRTY_DAY_PAYMENT_TYPES,
    exclude_refinanced: bool = True,
    exclude_refinancing: bool = False,
    checkpoint: bool = False,
    cache: bool = False,
) -> CohortSeries:
    """Overall and group trailing late ratios from a single pass over the facts.

    The facts are reduced once to counts per (in_group, day), a table bounded
    by the calendar; the overall series sums its two groups.  With
    ``checkpoint=True`` that small table is written to the cluster's shared
    ``spark.checkpoint.dir`` first, so both series (and any re-run after a
    lost executor) read it instead of re-running the joins.  ``cache=True``
    keeps it in executor storage instead: reused while it lasts, recomputed
    from lineage if an executor holding it is lost.
    """
    if day not in DAY_KEYS:
        raise ValueError(f"day must be one of {DAY_KEYS}, not {day!r}")
    # Payments are summed per loan before the join (creation-day key), or joined
    # row by row with hot loans salted (due-day key).
    keys = [] if day == "created_day" else ["dtpayment"]
    facts = payment_facts(tables, as_of, keys=keys, payment_types=payment_types,
                          exclude_refinanced=exclude_refinanced,
                          exclude_refinancing=exclude_refinancing)
    flagged = (facts.where(F.col(day) <= F.lit(as_date(as_of)))
               .withColumn("in_group", column_in_values(facts, "country", values)))
    daily = daily_counts(flagged, day, by=["in_group"])
    if checkpoint:
        checkpoint_dir(daily.sparkSession)
        daily = daily.checkpoint(eager=True)
    elif cache:
        daily = daily.persist()
    total_daily = (daily.groupBy("day")
                   .agg(F.sum("ontime").alias("ontime"), F.sum("late").alias("late"),
                        F.sum("never").alias("never"))
                   .withColumn("ontime_pct", percent("ontime", F.col("ontime") + F.col("late"))))
    total = trailing_late_ratio(total_daily, days, as_of=as_of)
    groups = daily if include_rest else daily.where(F.col("in_group"))
    by_group = trailing_late_ratio(groups, days, by=["in_group"], as_of=as_of)
    return CohortSeries(total=total, by_group=by_group, daily=daily)


def monthly_report(
    tables: LoanTables,
    as_of: str | dt.date | dt.datetime,
    start: str | dt.date = DEFAULT_MONTHLY_START,
    periods: int = DEFAULT_MONTHLY_PERIODS,
    payment_types: Iterable[int] | None = THIRTY_DAY_PAYMENT_TYPES,
    exclude_refinanced: bool = True,
    exclude_refinancing: bool = False,
    day: str = DEFAULT_DAY_KEY,
) -> DataFrame:
    """Monthly cohorts x instalment number over the ``periods`` months from
    ``start``: by the loan's creation day (the span is applied to the loans
    before any join) or, with ``day='dtpayment'``, by the payment's due day
    (the span is applied in the payments scan)."""
    if day not in DAY_KEYS:
        raise ValueError(f"day must be one of {DAY_KEYS}, not {day!r}")
    bounds = period_bounds(as_date(start), int(periods))
    span = (bounds[0], bounds[-1])
    if day == "dtpayment":
        facts = payment_facts(tables, as_of, keys=["dtpayment", "multi_payment_number"],
                              payment_types=payment_types,
                              exclude_refinanced=exclude_refinanced,
                              exclude_refinancing=exclude_refinancing,
                              due_between=span, with_country=False)
        return monthly_instalment_cohorts(facts, bounds[0], periods, "dtpayment")
    # Summed per (loan, instalment) first: a loan's rows are bounded by its
    # number of instalments, however many payments it holds.
    facts = payment_facts(tables, as_of, keys=["multi_payment_number"],
                          payment_types=payment_types,
                          exclude_refinanced=exclude_refinanced,
                          exclude_refinancing=exclude_refinancing,
                          created_between=span, with_country=False)
    return monthly_instalment_cohorts(facts, bounds[0], periods, "created_day")
