"""Loan-repayment analytics as Spark DataFrame operators.

Cohort view: trailing late-payment ratios by due day or loan-creation day, in
total and split by a borrower group, and monthly creation cohorts by
instalment number.  Factor view: repaid/late tables for one borrower
attribute.  Every operator is a pure function from DataFrames and parameters
to a lazy DataFrame; nothing is collected and no Python UDF is used.
"""

from . import functions, operators, plans, presets, sources
from .session import checkpoint_dir, cluster_conf, configure, local_session

__all__ = [
    "checkpoint_dir", "cluster_conf", "configure", "functions", "local_session",
    "operators", "plans", "presets", "sources",
]
