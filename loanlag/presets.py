"""Named value groups and default parameters.

Every operator takes these as ordinary arguments; nothing here is read as
global state.  The lists below are FIXED VALUES: they must equal the ones the
original analysis used, because they decide which rows fall in a group.
"""

from __future__ import annotations

# --- fixed values (must match the original analysis exactly) ---------------
# Countries treated as "developed": ISO codes mixed with a few full names.
DEVELOPED_COUNTRIES = (
    "AD", "AT", "AU", "BE", "CA", "CH", "DE", "DK", "ES", "IE", "EU", "FI",
    "FR", "GB", "GG", "GI", "HK", "IM", "IR", "IS", "IT", "JE", "JP", "KR",
    "LU", "MC", "MP", "MT", "NL", "NO", "NZ", "PT", "RE", "SE", "SG", "SM",
    "SV", "SZ", "UK", "US", "A1", "United States", "United Kingdom",
    "Belgium", "Australia", "Italy", "India", "Netherlands", "Canada",
)
# Countries behind the October late-payment spike.  'PH' is listed twice and
# 'None' is the literal string, which never matches a null country.
OCT_SPIKE_GROUP = ("MX", "PH", "RU", "PH", "PL", "UA", "RO", "None", "MD")
# Group compared against everyone else by default.
DEFAULT_GROUP = DEVELOPED_COUNTRIES + OCT_SPIKE_GROUP
# Payment types with 30-day terms, and the weekly type.
THIRTY_DAY_PAYMENT_TYPES = (4, 5, 6)
WEEKLY_PAYMENT_TYPES = (3,)
# Trailing window length in days.
DEFAULT_WINDOW_DAYS = 30
# Monthly cohort report: first period start and number of periods.
DEFAULT_MONTHLY_START = "2014-09-01"
DEFAULT_MONTHLY_PERIODS = 6
# Borrower attributes of a credit report that a payback table can split on
# (the column name is the lower-cased selector).
FACTORS = (
    "country", "credit_label", "has_credit_check", "has_job",
    "has_fake_email", "gender", "has_verified_phone", "has_linkedin_login",
    "has_otc", "has_bitcointalk", "has_verified_address", "has_ebay",
    "paypal_email_consistency", "geo_demerit", "linkedin_connections",
    "account_age", "strongly_connected",
)
# --- end of fixed values ----------------------------------------------------

# Day keys a cohort series can be built on.
DAY_KEYS = ("created_day", "dtpayment")
DEFAULT_DAY_KEY = "created_day"
