from .eligibility import due_payments, eligible_listings, open_loans
from .facts import loan_borrowers, loan_status_counts, loan_weights, payment_facts, payment_status
from .joins import anti_join_nullable, left_join_nullable, splittable_join
from .monthly import in_cohort_order, monthly_instalment_cohorts
from .ordering import cohort_positions, day_positions, payback_positions, with_position
from .payback import (all_factor_payback, behaviour_payback, by_late_pct, exclude_values, factor_payback,
                      payback_totals)
from .series import (all_payments_daily, all_payments_late_ratio, daily_counts, group_late_ratio,
                     in_day_order, late_ratio, trailing_late_ratio)

__all__ = [
    "all_factor_payback", "all_payments_daily", "all_payments_late_ratio", "anti_join_nullable",
    "behaviour_payback", "by_late_pct", "cohort_positions", "daily_counts", "day_positions", "due_payments", "eligible_listings",
    "exclude_values", "factor_payback", "group_late_ratio", "in_cohort_order", "in_day_order",
    "late_ratio",
    "left_join_nullable", "loan_borrowers", "loan_status_counts", "loan_weights",
    "monthly_instalment_cohorts", "open_loans", "payback_positions", "payback_totals",
    "payment_facts", "payment_status", "splittable_join", "trailing_late_ratio", "with_position",
]
