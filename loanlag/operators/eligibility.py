"""Row eligibility: due payments (W2), open loans (W3), eligible listings (W4)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_timestamp
from ..presets import THIRTY_DAY_PAYMENT_TYPES
from .joins import anti_join_nullable


def due_payments(payments: DataFrame, as_of: str | dt.date | dt.datetime) -> DataFrame:
    """Payments whose due day lies before the ``as_of`` instant.

    The due day is a date and ``as_of`` an instant, so a payment due on the
    ``as_of`` day itself is due once that day has begun.  The comparison is
    rewritten on the driver into a plain date predicate, which the scan can
    push down (a cast on the column could not be).
    """
    ts = as_timestamp(as_of)
    day = ts.date()
    if ts == dt.datetime(day.year, day.month, day.day):
        return payments.where(F.col("dtpayment") < F.lit(day))
    return payments.where(F.col("dtpayment") <= F.lit(day))


def open_loans(loans: DataFrame) -> DataFrame:
    """Loans not reimbursed.  A null ``reimbursed`` is *not* false: dropped."""
    return loans.where(F.col("reimbursed") == F.lit(False))


def eligible_listings(
    listings: DataFrame,
    payment_types: Iterable[int] | None = THIRTY_DAY_PAYMENT_TYPES,
    exclude_refinanced: bool = True,
    exclude_refinancing: bool = False,
) -> DataFrame:
    """Listings whose loans enter the cohort analysis.

    * ``payment_types``: keep these payment types; ``None`` keeps all.
    * ``exclude_refinanced``: drop a listing that another listing names as its
      parent (the loan was refinanced).
    * ``exclude_refinancing``: drop a listing whose parent is a known listing.

    Both exclusions are anti joins against the *whole* listings table, not
    just the eligible part.
    """
    cols = listings.columns
    out = listings
    if payment_types is not None:
        out = out.where(F.col("payment_type_id").isin([int(t) for t in payment_types]))
    if exclude_refinanced:
        # Distinct before the anti join: its partial aggregate shrinks the
        # shuffle when a parent is named many times, and the anti join reuses
        # the aggregate's partitioning (no second exchange on that side).
        parents = (listings.where(F.col("parent_listing_id").isNotNull())
                   .select(F.col("parent_listing_id").alias("id")).distinct())
        out = out.join(parents, "id", "left_anti")
    if exclude_refinancing:
        known = listings.select(F.col("id").alias("_known_id"))
        out = anti_join_nullable(out, known, "parent_listing_id", "_known_id", spread_on=["id"])
    return out.select(*cols)
