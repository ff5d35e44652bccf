"""Payment status flags and the percentages built on them.

A payment is *on time* when it was paid on or before its due day, and *late*
otherwise; a payment never paid (null ``dtpaid``) is late **and** never paid.
So ``ontime + late == 1`` for every payment and ``never <= late``.  The flags
are plain CASE expressions, evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ontime_flag(due: ColumnOrName = "dtpayment", paid: ColumnOrName = "dtpaid") -> Column:
    """1 when paid on or before the due day, else 0 (null paid -> 0)."""
    return F.when(_c(paid).isNotNull() & (_c(paid) <= _c(due)), 1).otherwise(0)


def late_flag(due: ColumnOrName = "dtpayment", paid: ColumnOrName = "dtpaid") -> Column:
    """1 when never paid or paid after the due day, else 0."""
    return F.when(_c(paid).isNull() | (_c(due) < _c(paid)), 1).otherwise(0)


def never_flag(paid: ColumnOrName = "dtpaid") -> Column:
    """1 when never paid; a subset of ``late_flag``."""
    return F.when(_c(paid).isNull(), 1).otherwise(0)


def status_columns(due: ColumnOrName = "dtpayment", paid: ColumnOrName = "dtpaid") -> list[Column]:
    """``ontime``, ``late`` and ``never`` as named int columns."""
    return [
        ontime_flag(due, paid).alias("ontime"),
        late_flag(due, paid).alias("late"),
        never_flag(paid).alias("never"),
    ]


def percent(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """``part * 100.0 / whole`` as a double; null when ``whole`` is 0."""
    return F.try_divide(_c(part) * 100.0, _c(whole))


def count_true(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (null counts as false), as long."""
    return F.count_if(cond)
