"""Column contracts of the five input tables.

Only the columns some operator reads are listed.  Types follow how the
analysis uses each column (dates are compared and subtracted, flags are tested
for ``True``); the original source declared no schema.
"""

from __future__ import annotations

from pyspark.sql import types as T

FACTOR_TYPES = {
    "country": T.StringType(),
    "credit_label": T.StringType(),
    "has_credit_check": T.BooleanType(),
    "has_job": T.BooleanType(),
    "has_fake_email": T.BooleanType(),
    "gender": T.StringType(),
    "has_verified_phone": T.BooleanType(),
    "has_linkedin_login": T.BooleanType(),
    "has_otc": T.BooleanType(),
    "has_bitcointalk": T.BooleanType(),
    "has_verified_address": T.BooleanType(),
    "has_ebay": T.BooleanType(),
    "paypal_email_consistency": T.BooleanType(),
    "geo_demerit": T.LongType(),
    "linkedin_connections": T.LongType(),
    "account_age": T.LongType(),
    "strongly_connected": T.BooleanType(),
}


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


MULTI_PAYMENTS = _struct(
    ("id", T.LongType()),
    ("loan_id", T.LongType()),
    ("dtpayment", T.DateType()),
    ("dtpaid", T.DateType()),
    ("total_multi_payments", T.IntegerType()),
    ("multi_payment_number", T.IntegerType()),
)

LOANS = _struct(
    ("user_id", T.LongType()),
    ("id", T.LongType()),
    ("created_at", T.TimestampNTZType()),
    ("reimbursed", T.BooleanType()),
)

USERS = _struct(
    ("id", T.LongType()),
    ("country", T.StringType()),
    ("bad_behavior", T.BooleanType()),
)

LISTINGS = _struct(
    ("id", T.LongType()),
    ("user_id", T.LongType()),
    ("loan_id", T.LongType()),
    ("payment_type_id", T.IntegerType()),
    ("parent_listing_id", T.LongType()),
)

CREDIT_REPORTS = _struct(
    ("id", T.LongType()),
    ("user_id", T.LongType()),
    *FACTOR_TYPES.items(),
    ("pays_in_time", T.LongType()),
    ("is_late", T.BooleanType()),
    ("repaid_loans", T.LongType()),
    ("active_loans", T.LongType()),
)

SCHEMAS: dict[str, T.StructType] = {
    "multi_payments": MULTI_PAYMENTS,
    "loans": LOANS,
    "users": USERS,
    "listings": LISTINGS,
    "credit_reports": CREDIT_REPORTS,
}
