from .dates import as_date, as_timestamp, month_index, next_month_same_day, period_bounds
from .status import count_true, late_flag, never_flag, ontime_flag, percent, status_columns
from .values import column_in_values, in_values

__all__ = [
    "as_date", "as_timestamp", "column_in_values", "count_true", "in_values",
    "late_flag", "month_index", "never_flag", "next_month_same_day",
    "ontime_flag", "percent", "period_bounds", "status_columns",
]
