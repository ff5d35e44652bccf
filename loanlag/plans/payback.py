"""Payback pipelines: a factor or behaviour table with its totals."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.payback import behaviour_payback, exclude_values, factor_payback, payback_totals


@dataclass(frozen=True)
class PaybackReport:
    """``table`` and ``totals`` both come from ``grouped``, one row per value."""

    table: DataFrame
    totals: DataFrame
    grouped: DataFrame


def factor_report(reports: DataFrame, factor: str = "country",
                  exclude: Iterable | None = None, cache: bool = False) -> PaybackReport:
    """Payback by ``factor``; ``exclude`` drops listed values from the table
    and from the late/not-late totals, while ``negative_customers`` still
    counts every late report.  With ``cache`` the grouped table is persisted,
    so that writing both scans the reports once; the caller releases it
    (``grouped.unpersist()``).  No value is excluded unless asked for: the
    developed countries are ``presets.DEVELOPED_COUNTRIES``."""
    full = factor_payback(reports, factor)
    full = full.persist() if cache else full
    exclude = list(exclude) if exclude is not None else None
    table = exclude_values(full, exclude, factor.lower()) if exclude is not None else full
    return PaybackReport(table=table, totals=payback_totals(full, exclude, factor.lower()), grouped=full)


def behaviour_report(users: DataFrame, reports: DataFrame, positive: str = "repaid",
                     cache: bool = False) -> PaybackReport:
    """Payback by the user's ``bad_behavior`` flag, with totals; ``cache`` as in ``factor_report``."""
    table = behaviour_payback(users, reports, positive)
    table = table.persist() if cache else table
    return PaybackReport(table=table, totals=payback_totals(table), grouped=table)
