"""Payback tables from credit reports (W14-W17).

A report is *positive* when it shows a repaid loan (``repaid_loans > 0``) and
*negative* when it is flagged late (``is_late`` true).  The two are not
exclusive, so ``late_pct = negative / (negative + positive)`` is a share of
flags, not of customers.  A value with neither flag does not appear.

Each table is one grouped aggregation with conditional counts.  Null is an
ordinary group value.  Partial aggregation before the shuffle makes a value
holding a third of all reports cost one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import count_true, percent
from ..functions.values import column_in_values
from ..presets import DEVELOPED_COUNTRIES, FACTORS

POSITIVE_RULES = ("repaid", "good_behaviour")


def _finish(grouped: DataFrame, key: str) -> DataFrame:
    return (grouped.where(F.col("positive") + F.col("negative") > 0)
            .select(key, "positive", "negative",
                    percent("negative", F.col("negative") + F.col("positive")).alias("late_pct")))


def factor_payback(reports: DataFrame, factor: str = "country") -> DataFrame:
    """Per value of ``factor``: ``positive``, ``negative``, ``late_pct`` (W14).

    Numeric factors group by exact value.  Unknown factors raise.
    """
    factor = factor.lower()
    if factor not in FACTORS:
        raise ValueError(f"unknown factor {factor!r}; choose from {FACTORS}")
    grouped = reports.groupBy(factor).agg(
        count_true(F.col("repaid_loans") > 0).alias("positive"),
        count_true(F.col("is_late")).alias("negative"))
    return _finish(grouped, factor)


def all_factor_payback(reports: DataFrame, factors: Iterable[str] = FACTORS) -> DataFrame:
    """``factor_payback`` of several factors from one scan: ``factor``,
    ``value`` (as text), ``positive``, ``negative``, ``late_pct``.

    Each report becomes one row per factor in memory; those are summed per
    (factor, value) before the only shuffle.
    """
    factors = [f.lower() for f in factors]
    unknown = [f for f in factors if f not in FACTORS]
    if unknown or not factors:
        raise ValueError(f"unknown factors {unknown}; choose from {FACTORS}")
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("value")) for f in factors])
    # Reports with neither flag count nowhere.
    flagged = reports.select(pairs.alias("pairs"), (F.col("repaid_loans") > 0).alias("repaid"), "is_late").where(
        F.col("repaid") | F.col("is_late"))
    grouped = flagged.select(F.explode("pairs").alias("pair"), "repaid", "is_late").groupBy(
        F.col("pair.factor").alias("factor"), F.col("pair.value").alias("value")).agg(
        count_true(F.col("repaid")).alias("positive"), count_true(F.col("is_late")).alias("negative"))
    return grouped.where(F.col("positive") + F.col("negative") > 0).select(
        "factor", "value", "positive", "negative",
        percent("negative", F.col("negative") + F.col("positive")).alias("late_pct"))


def exclude_values(table: DataFrame, values: Iterable = DEVELOPED_COUNTRIES,
                   column: str | None = None) -> DataFrame:
    """Drop rows whose ``column`` (default: the first) is one of ``values``.

    Null values are kept, and values of another type than the column never
    match (W15).
    """
    column = column or table.columns[0]
    return table.where(~column_in_values(table, column, values))


def behaviour_payback(users: DataFrame, reports: DataFrame, positive: str = "repaid") -> DataFrame:
    """Per user ``bad_behavior`` value: ``positive``, ``negative``,
    ``late_pct`` over users full-outer-joined to their credit reports (W16).

    Rows of the join: one per (user, report) match, one per user without a
    report and one per report without a user; the last group has a null
    ``bad_behavior``.  ``negative`` counts join rows of users flagged bad.
    ``positive`` counts join rows with a report showing a repaid loan
    (``repaid``) or join rows of users flagged not bad (``good_behaviour``).

    Reports are summed per ``user_id`` before the join, so the full outer
    join is one-to-one on unique keys and a user with a third of all reports
    costs one row.
    """
    if positive not in POSITIVE_RULES:
        raise ValueError(f"positive must be one of {POSITIVE_RULES}")
    per_user = reports.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_reports"),
        count_true(F.col("repaid_loans") > 0).alias("n_repaid"))
    u = users.select(F.col("id").alias("_uid"), "bad_behavior")
    joined = u.join(per_user, u["_uid"] == per_user["user_id"], "full")
    rows = F.coalesce(F.col("n_reports"), F.lit(1))
    bad = F.col("bad_behavior")
    if positive == "repaid":
        pos = F.coalesce(F.col("n_repaid"), F.lit(0))
    else:
        pos = F.when(bad == F.lit(False), rows).otherwise(0)
    neg = F.when(bad == F.lit(True), rows).otherwise(0)
    grouped = joined.groupBy("bad_behavior").agg(
        F.sum(pos).cast("long").alias("positive"),
        F.sum(neg).cast("long").alias("negative"))
    return _finish(grouped, "bad_behavior")


def payback_totals(payback: DataFrame, exclude: Iterable | None = None,
                   column: str | None = None) -> DataFrame:
    """One row: ``total_late``, ``total_not_late``, ``late_pct`` and
    ``negative_customers`` (W17).

    Totals are taken after excluding ``exclude`` values of ``column``;
    ``negative_customers`` counts every negative, before the exclusion.  An
    empty table gives zero counts and a null percentage.
    """
    column = column or payback.columns[0]
    kept = ~column_in_values(payback, column, exclude) if exclude is not None else F.lit(True)
    late = F.coalesce(F.sum(F.when(kept, F.col("negative")).otherwise(0)), F.lit(0)).cast("long")
    not_late = F.coalesce(F.sum(F.when(kept, F.col("positive")).otherwise(0)), F.lit(0)).cast("long")
    negatives = F.coalesce(F.sum("negative"), F.lit(0)).cast("long")
    totals = payback.agg(late.alias("total_late"), not_late.alias("total_not_late"),
                         negatives.alias("negative_customers"))
    return totals.select(
        "total_late", "total_not_late",
        percent("total_late", F.col("total_late") + F.col("total_not_late")).alias("late_pct"),
        "negative_customers")


def by_late_pct(table: DataFrame) -> DataFrame:
    """A payback table sorted by late percentage, then value (nulls first)."""
    return table.orderBy("late_pct", F.col(table.columns[0]).asc_nulls_first())
