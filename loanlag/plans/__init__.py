from .cohort import CohortSeries, cohort_late_ratios, monthly_report
from .inspect import exchange_count, plan_problems, plan_text, scanned_columns
from .payback import PaybackReport, behaviour_report, factor_report

__all__ = [
    "CohortSeries", "PaybackReport", "behaviour_report", "cohort_late_ratios",
    "exchange_count", "factor_report", "monthly_report", "plan_problems",
    "plan_text", "scanned_columns",
]
