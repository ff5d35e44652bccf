"""Output order as a column (O1-O3).

Files and hashes of rows do not keep an order; a position does.  Rows are
dealt into ranges by an expression of the leading order column, so the range
of a row never depends on sampling or on a retry.  Each range is numbered by
itself and begins where the counts of the ranges before it end, so no task
sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(table: DataFrame, order: list[str | Column], range_of: Column) -> DataFrame:
    """``table`` with ``position``, its rows numbered from 1 in the given order.

    ``range_of`` is an integer that does not fall along the order (null
    first).  The order should tell all rows apart: ties may be numbered either
    way.  The counts of the ranges, a row each, are added up in one task.
    ``table`` is evaluated twice, which share its last shuffle; persist it
    where it is costly.
    """
    ranged = table.withColumn("_range", range_of.cast("long"))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(F.col("_range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_own", own)
    joined = numbered.join(begins, F.col("_range").eqNullSafe(F.col("_of")))
    return joined.select(*table.columns, (F.col("_before") + F.col("_own")).cast("long").alias("position"))


def day_positions(series: DataFrame) -> DataFrame:
    """A daily or trailing series numbered by its groups, then day (O1): ranges are years, the group's years after the others'."""
    year = F.year("day")
    if "in_group" not in series.columns:
        return with_position(series, ["day"], year)
    return with_position(series, ["in_group", "day"], F.col("in_group").cast("int") * 100_000 + year)


def cohort_positions(report: DataFrame) -> DataFrame:
    """The monthly report numbered by period, then instalment number (O2): a range is a period."""
    return with_position(report, ["cohort_start", "multi_payment_number"], F.unix_date(F.col("cohort_start").cast("date")))


def payback_positions(table: DataFrame) -> DataFrame:
    """A payback table numbered by late percentage, then value, nulls first (O3): a range is a whole per cent."""
    return with_position(table, ["late_pct", F.col(table.columns[0]).asc_nulls_first()], F.floor("late_pct"))
