"""Payment facts: status flags (W5), borrower side (W6) and facts (W7).

A *fact* is one due payment paired with one eligible listing of its loan,
carrying the borrower's country and the loan's creation day.  A loan with
two eligible listings contributes its payments twice: the fan-out is part of
the analysis and is kept.

Plan shape.  The payments table is by far the largest input, and one loan
may hold a third of it.  Creation-day series only need per-loan counts: the
payments are summed per loan with a partial aggregate *before* the first
shuffle (``keys=[]``, ``loan_status_counts``), so that shuffle carries one
row per loan per map task and a hot loan costs nothing extra.  Keys that vary
per payment (due day, instalment number) are nearly unique per (loan, key),
so pre-summing would not shrink anything; those facts join payment rows to
the loan side once, as a join that AQE can split (``joins.splittable_join``):
the payments of a loan holding a third of them are read by many tasks, each
with its loan-side row.  The loan side's filters feed a runtime bloom filter
that drops other loans' payments before that shuffle.  Where AQE is off, or
may not split, ``hot_loan_rows`` asks for a salted join instead
(``joins.salted_join``).  A report over a creation span (the monthly cohorts)
pre-sums per loan and key, below the same bloom filter.
Listings are counted per loan first (``loan_weights``), so every counting
join is one-to-one on the loan.  The detail form (``keys=None``) keeps one
row per payment and listing, joined with the same salting.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import status_columns
from ..presets import THIRTY_DAY_PAYMENT_TYPES
from ..sources.readers import LoanTables
from .eligibility import due_payments, eligible_listings, open_loans
from .joins import hot_keys, left_join_nullable, salted_join, splittable_join

FACT_KEYS = ("dtpayment", "multi_payment_number")


def payment_status(payments: DataFrame) -> DataFrame:
    """Payments with ``ontime``, ``late`` and ``never`` flags (ints)."""
    return payments.select(
        "id", "loan_id", "dtpayment", "dtpaid", "multi_payment_number", *status_columns())


def loan_borrowers(loans: DataFrame, users: DataFrame | None, listings: DataFrame) -> DataFrame:
    """One row per (loan, eligible listing): ``loan_id``, ``country``,
    ``created_at``, ``created_day``.

    ``loans``/``listings`` are expected already filtered (``open_loans``,
    ``eligible_listings``).  A loan without a known user keeps a null country.
    The user join comes first so the following listing join and the payment
    join share one partitioning on ``loan_id``.

    ``users=None`` leaves out the user join and the ``country`` column: as
    ``users.id`` is the users' key, a left join to it never adds or removes
    loan rows, so a caller that does not need the country skips one shuffle
    of the loans and the users scan.
    """
    l = loans.select(F.col("id").alias("loan_id"), "user_id", "created_at")
    cols = ["loan_id", "created_at", F.to_date("created_at").alias("created_day")]
    if users is not None:
        u = users.select(F.col("id").alias("_uid"), "country")
        l = left_join_nullable(l, u, "user_id", "_uid", spread_on=["loan_id"])
        cols.insert(1, "country")
    lst = listings.select("loan_id")
    return l.join(lst, "loan_id").select(*cols)


def loan_weights(loans: DataFrame, users: DataFrame | None, listings: DataFrame) -> DataFrame:
    """One row per loan with at least one eligible listing: ``loan_id``,
    ``country`` (unless ``users`` is None), ``created_day`` and ``listings``,
    the number of its eligible listings.

    The counting form of ``loan_borrowers``: the listing fan-out only
    multiplies a loan's counts, so listings are counted per loan (partial
    aggregate before the shuffle) and every later join is one-to-one on
    ``loan_id``.  A loan named by a third of all listings costs one row.
    """
    per_loan = (listings.where(F.col("loan_id").isNotNull())
                .groupBy("loan_id").agg(F.count(F.lit(1)).alias("listings")))
    l = loans.select(F.col("id").alias("loan_id"), "user_id", "created_at")
    cols = ["loan_id", F.to_date("created_at").alias("created_day"), "listings"]
    if users is not None:
        u = users.select(F.col("id").alias("_uid"), "country")
        l = left_join_nullable(l, u, "user_id", "_uid", spread_on=["loan_id"])
        cols.insert(1, "country")
    return l.join(per_loan, "loan_id").select(*cols)


def loan_status_counts(payments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per ``loan_id`` (and ``keys``): sums of ``ontime``, ``late``, ``never``."""
    bad = [k for k in keys if k not in FACT_KEYS]
    if bad:
        raise ValueError(f"unknown fact keys {bad}; choose from {FACT_KEYS}")
    return (payments.select("loan_id", *keys, *status_columns())
            .groupBy("loan_id", *keys)
            .agg(F.sum("ontime").alias("ontime"), F.sum("late").alias("late"),
                 F.sum("never").alias("never")))


def payment_facts(
    tables: LoanTables,
    as_of: str | dt.date | dt.datetime,
    keys: Sequence[str] | None = None,
    payment_types: Iterable[int] | None = THIRTY_DAY_PAYMENT_TYPES,
    exclude_refinanced: bool = True,
    exclude_refinancing: bool = False,
    created_between: tuple[dt.date | None, dt.date | None] = (None, None),
    due_between: tuple[dt.date | None, dt.date | None] = (None, None),
    with_country: bool = True,
    hot_loan_rows: int | None = None,
    colocated: bool = False,
) -> DataFrame:
    """Payment facts of the cohort analysis (W7).

    ``keys=None`` gives one row per payment x eligible listing with int flags:
    ``loan_id, country, created_day, dtpayment, multi_payment_number, ontime,
    late, never``.  With ``keys`` the counts are weighted by the loan's number
    of eligible listings instead of repeating rows, giving ``loan_id, country,
    created_day, *keys, ontime, late, never`` with long counts: ``keys=[]``
    pre-sums the payments per loan before the join (one row per loan);
    ``keys`` naming ``dtpayment``/``multi_payment_number`` keep one row per
    payment, unless ``created_between`` narrows the loans: then payments are
    pre-summed per loan and key below the shuffle.  Summing any form gives the
    same totals.

    ``hot_loan_rows``: salt eligible loans with more due payments than this
    over tasks of about that many.  They are counted by a second, narrow pass
    over the payments.  By default nothing is counted and AQE splits what the
    shuffle shows to be skewed.  ``colocated``: the tables are stored by loan
    (``sources.colocated``), so payments are joined where they lie, without a
    shuffle to split.

    ``created_between=(lo, hi)`` keeps loans created on ``lo <= day < hi``
    (either bound may be None); it is applied to the loans before any join.
    ``due_between`` does the same for the payments' due day, in their scan.
    ``with_country=False`` drops the ``country`` column and the user join
    behind it (see ``loan_borrowers``).
    """
    loans = open_loans(tables.loans)
    lo, hi = created_between
    created_day = F.to_date("created_at")
    if lo is not None:
        loans = loans.where(created_day >= F.lit(lo))
    if hi is not None:
        loans = loans.where(created_day < F.lit(hi))
    # True for every id.  Spark builds a runtime bloom filter only from a side
    # whose scan has a comparison; a boolean column alone is none.
    loans = loans.where(F.col("id") >= F.lit(-(2**63)))
    listings = eligible_listings(tables.listings, payment_types, exclude_refinanced,
                                 exclude_refinancing)
    users = tables.users if with_country else None
    due = due_payments(tables.multi_payments, as_of)
    due_lo, due_hi = due_between
    if due_lo is not None:
        due = due.where(F.col("dtpayment") >= F.lit(due_lo))
    if due_hi is not None:
        due = due.where(F.col("dtpayment") < F.lit(due_hi))
    country = ["country"] if with_country else []
    spread = ["id", "dtpayment", "multi_payment_number"]
    weights = loan_weights(loans, users, listings)

    def joined_to_loans(rows: DataFrame) -> DataFrame:
        if colocated:
            return rows.join(weights, "loan_id")
        if hot_loan_rows is None:
            return splittable_join(rows, weights, "loan_id")
        # Only eligible loans are listed: the others have nothing to meet.
        hot = hot_keys(due.select("loan_id"), "loan_id", hot_loan_rows, among=weights)
        return salted_join(rows, weights, "loan_id", hot, spread)

    if keys is None:
        # One row per loan enters the join; a loan's listings fan out after
        # it, so the fan-out is never shuffled and never replicated.
        facts = joined_to_loans(payment_status(due))
        facts = facts.withColumn("_listing", F.explode(F.sequence(F.lit(1).cast("long"), F.col("listings"))))
        return facts.select("loan_id", *country, "created_day", "dtpayment",
                            "multi_payment_number", "ontime", "late", "never")
    keys = list(keys)
    bad = [k for k in keys if k not in FACT_KEYS]
    if bad:
        raise ValueError(f"unknown fact keys {bad}; choose from {FACT_KEYS}")
    if keys and lo is None and hi is None:
        rows = due.select("loan_id", *dict.fromkeys([*keys, *spread]), *status_columns())
        joined = joined_to_loans(rows)
    else:
        # Per-loan (and key) sums first.  With a creation span the loan side
        # is selective, and Spark's runtime bloom filter from it prunes the
        # payments in the scan, before the partial aggregate.  A loan's rows
        # stay bounded by its distinct keys.
        joined = loan_status_counts(due, keys).join(weights, "loan_id")
    n = F.col("listings")
    return joined.select(
        "loan_id", *country, "created_day", *keys,
        (F.col("ontime") * n).cast("long").alias("ontime"),
        (F.col("late") * n).cast("long").alias("late"),
        (F.col("never") * n).cast("long").alias("never"))
