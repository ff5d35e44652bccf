"""Registered queries over the driver's test tables, with oracle SQL.

Each query binds the test tables to the five loan tables
(``sources.fixture``) and runs one operator with the fixture parameters.  The
oracle SQL for the same name re-derives the answer in plain SQL, written the
way the original analysis phrased it (``NOT IN`` subqueries, positive and
negative counts joined back together, a join to explicit month periods), so
it checks the Spark formulation rather than repeating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import (all_factor_payback, all_payments_daily, all_payments_late_ratio, behaviour_payback,
                         cohort_positions, daily_counts, day_positions, due_payments, eligible_listings, exclude_values,
                         factor_payback, group_late_ratio, late_ratio, loan_borrowers,
                         open_loans, payback_positions, payback_totals, payment_facts, payment_status)
from ..presets import DEFAULT_GROUP, DEVELOPED_COUNTRIES, FACTORS
from ..sources.fixture import NATION_CODES, load_fixture
from .cohort import cohort_late_ratios, monthly_report
from .payback import behaviour_report, factor_report

# Parameters of the fixture runs.
AS_OF = "2001-06-30 12:00:00"
AS_OF_DAY = "2001-06-30"
GROUP = ("NATION_1", "NATION_2", "NATION_3")
MONTHLY_START = "2000-09-01"
MONTHLY_START_MID = "2000-09-15"
MONTHLY_PERIODS = 6
WINDOW = 30

Query = Callable[[SparkSession, str], DataFrame]


def _facts(t, keys=None, with_country=True):
    return payment_facts(t, AS_OF, keys=keys, with_country=with_country)


def _build_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def reg(name: str):
        def wrap(fn):
            q[name] = lambda spark, sf_dir, fn=fn: fn(load_fixture(spark, sf_dir))
            return fn
        return wrap

    # W1: the five tables as the analysis sees them, each a DataFrame of its own: running one leaves the shared plans unrun.
    for table in ("users", "loans", "listings", "multi_payments", "credit_reports"):
        reg(f"load_{table}")(lambda t, table=table: getattr(t, table).select("*"))

    # W2-W4
    reg("due_payments")(lambda t: due_payments(t.multi_payments, AS_OF))
    reg("open_loans")(lambda t: open_loans(t.loans))
    reg("eligible_listings")(lambda t: eligible_listings(t.listings))
    reg("eligible_listings_weekly")(
        lambda t: eligible_listings(t.listings, (3,), exclude_refinanced=False))
    reg("eligible_listings_all_types")(
        lambda t: eligible_listings(t.listings, None, exclude_refinanced=False))
    reg("eligible_listings_keep_refinanced")(
        lambda t: eligible_listings(t.listings, exclude_refinanced=False))
    reg("eligible_listings_no_refinancing")(
        lambda t: eligible_listings(t.listings, exclude_refinanced=False, exclude_refinancing=True))

    # W5-W7
    reg("payment_status")(lambda t: payment_status(due_payments(t.multi_payments, AS_OF)))
    reg("loan_borrowers")(
        lambda t: loan_borrowers(open_loans(t.loans), t.users, eligible_listings(t.listings)))
    reg("payment_facts")(lambda t: _facts(t))

    # W8-W11, W13
    reg("daily_counts_created")(lambda t: daily_counts(_facts(t, [], with_country=False), "created_day"))
    reg("daily_counts_due")(lambda t: daily_counts(_facts(t, ["dtpayment"], with_country=False), "dtpayment"))
    reg("late_ratio_created")(lambda t: late_ratio(_facts(t, [], with_country=False), "created_day", WINDOW, AS_OF))
    reg("late_ratio_due")(lambda t: late_ratio(_facts(t, ["dtpayment"], with_country=False), "dtpayment", WINDOW, AS_OF))
    reg("late_ratio_7d")(lambda t: late_ratio(_facts(t, [], with_country=False), "created_day", 7, AS_OF))
    reg("late_ratio_by_group_created")(
        lambda t: group_late_ratio(_facts(t, []), GROUP, True, "created_day", WINDOW, AS_OF))
    reg("late_ratio_by_group_default")(
        lambda t: group_late_ratio(_facts(t, []), DEFAULT_GROUP, True, "created_day", WINDOW, AS_OF))
    reg("late_ratio_by_group_due")(
        lambda t: group_late_ratio(_facts(t, ["dtpayment"]), GROUP, True, "dtpayment", WINDOW, AS_OF))
    reg("late_ratio_group_only")(
        lambda t: group_late_ratio(_facts(t, []), GROUP, False, "created_day", WINDOW, AS_OF))
    reg("late_ratio_all_payments")(lambda t: all_payments_late_ratio(t.multi_payments, AS_OF, WINDOW))
    # Listing options carried through the whole series.
    reg("late_ratio_created_weekly")(lambda t: late_ratio(
        payment_facts(t, AS_OF, keys=[], payment_types=(3,), exclude_refinanced=False,
                      with_country=False), "created_day", WINDOW, AS_OF))
    reg("late_ratio_due_no_refinancing")(lambda t: late_ratio(
        payment_facts(t, AS_OF, keys=["dtpayment"], exclude_refinancing=True, with_country=False),
        "dtpayment", WINDOW, AS_OF))
    # The same due-day series with every loan of more than one payment treated
    # as hot, each dealt into as many buckets as it has payments, so the salted join path is checked
    # against the oracle on the real tables, not only under synthetic skew.
    reg("late_ratio_due_salted")(lambda t: late_ratio(
        payment_facts(t, AS_OF, keys=["dtpayment"], with_country=False, hot_loan_rows=1), "dtpayment", WINDOW, AS_OF))
    reg("daily_counts_all_payments")(lambda t: all_payments_daily(t.multi_payments, AS_OF))
    # Entry A as one pipeline: both series from one pass over the facts.
    reg("cohort_total_created")(lambda t: cohort_late_ratios(t, AS_OF, values=GROUP).total)
    reg("cohort_by_group_due")(
        lambda t: cohort_late_ratios(t, AS_OF, day="dtpayment", values=GROUP).by_group)

    # W12
    reg("monthly_instalment_cohorts")(
        lambda t: monthly_report(t, AS_OF, MONTHLY_START, MONTHLY_PERIODS))
    reg("monthly_instalment_cohorts_mid_month")(
        lambda t: monthly_report(t, AS_OF, MONTHLY_START_MID, MONTHLY_PERIODS))

    reg("monthly_instalment_cohorts_due")(
        lambda t: monthly_report(t, AS_OF, MONTHLY_START, MONTHLY_PERIODS, day="dtpayment"))

    # W14-W18
    for factor in FACTORS:
        reg(f"factor_payback_{factor}")(lambda t, f=factor: factor_payback(t.credit_reports, f))
    reg("factor_payback_country_excluding")(
        lambda t: exclude_values(factor_payback(t.credit_reports, "country"), GROUP, "country"))
    reg("factor_payback_country_excluding_developed")(
        lambda t: factor_report(t.credit_reports, "country", DEVELOPED_COUNTRIES).table)
    reg("factor_payback_geo_demerit_excluding")(
        lambda t: factor_report(t.credit_reports, "geo_demerit", (1, 2)).table)
    reg("factor_payback_has_job_excluding")(
        lambda t: factor_report(t.credit_reports, "has_job", (True,)).table)
    reg("payback_totals_geo_demerit_excluding")(
        lambda t: factor_report(t.credit_reports, "geo_demerit", (1, 2)).totals)
    reg("behaviour_payback")(lambda t: behaviour_payback(t.users, t.credit_reports))
    reg("behaviour_payback_good")(
        lambda t: behaviour_payback(t.users, t.credit_reports, "good_behaviour"))
    reg("payback_totals")(lambda t: payback_totals(factor_payback(t.credit_reports, "country")))
    reg("payback_totals_excluding")(
        lambda t: factor_report(t.credit_reports, "country", GROUP).totals)
    reg("factor_payback_all")(lambda t: all_factor_payback(t.credit_reports))
    # O1-O3: order shown as a column, as a set of rows has none.
    reg("late_ratio_created_positions")(lambda t: day_positions(
        late_ratio(_facts(t, [], with_country=False), "created_day", WINDOW, AS_OF)))
    reg("late_ratio_by_group_positions")(lambda t: day_positions(
        group_late_ratio(_facts(t, []), GROUP, True, "created_day", WINDOW, AS_OF)))
    reg("monthly_cohort_positions")(
        lambda t: cohort_positions(monthly_report(t, AS_OF, MONTHLY_START, MONTHLY_PERIODS)))
    reg("factor_payback_country_positions")(
        lambda t: payback_positions(factor_payback(t.credit_reports, "country")))
    reg("behaviour_payback_totals")(lambda t: behaviour_report(t.users, t.credit_reports).totals)
    return q


# --------------------------------------------------------------------------
# Oracle SQL (DuckDB).  The base views are the driver's tables; the loan
# tables are re-derived here as CTEs.

_BINDINGS = """
users AS (
  SELECT CASE WHEN c_custkey % 17 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS id,
         CASE n_name {codes} ELSE n_name END AS country,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal < 0 END AS bad_behavior
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
loans AS (
  SELECT o_custkey AS user_id, o_orderkey AS id, o_orderdate AS created_at,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus = 'P' END AS reimbursed
  FROM orders),
listings_first AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey END AS loan_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + 1 AS payment_type_id,
         CASE WHEN o_orderkey > 0 AND o_orderkey % 10 = 0 THEN o_orderkey - 1 END AS parent_listing_id
  FROM orders),
listings AS (
  SELECT * FROM listings_first
  UNION ALL
  SELECT id + 1000000000, user_id, loan_id, payment_type_id, CAST(NULL AS BIGINT)
  FROM listings_first WHERE id % 41 = 0),
multi_payments AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS loan_id,
         CAST(l_shipdate AS DATE) AS dtpayment,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL
              ELSE CAST(l_shipdate + (l_partkey % 41 - 25) * INTERVAL '1' DAY AS DATE) END AS dtpaid,
         7 AS total_multi_payments, l_linenumber AS multi_payment_number
  FROM lineitem),
report_people AS (
  SELECT c_custkey AS k, n_name, c_mktsegment, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
report_rows AS (
  SELECT k AS id, * FROM report_people
  UNION ALL
  SELECT k + 1000000000 AS id, * FROM report_people WHERE k % 11 = 0),
credit_reports AS (
  SELECT id,
         CASE WHEN k % 29 = 0 THEN NULL WHEN k % 7 = 0 THEN -k - 1000000000 ELSE k END AS user_id,
         CASE n_name {codes} ELSE n_name END AS country,
         c_mktsegment AS credit_label,
         CASE WHEN k % 5 = 0 THEN NULL ELSE k % 2 = 0 END AS has_credit_check,
         CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 = 0 END AS has_job,
         k % 37 = 0 AS has_fake_email,
         CASE k % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender,
         CASE WHEN k % 9 = 0 THEN NULL ELSE k % 4 = 0 END AS has_verified_phone,
         CASE WHEN k % 8 = 0 THEN NULL ELSE k % 5 = 0 END AS has_linkedin_login,
         CASE WHEN k % 11 = 0 THEN NULL ELSE k % 6 = 0 END AS has_otc,
         CASE WHEN k % 13 = 0 THEN NULL ELSE k % 10 = 0 END AS has_bitcointalk,
         CASE WHEN k % 10 = 0 THEN NULL ELSE k % 3 = 0 END AS has_verified_address,
         CASE WHEN k % 15 = 0 THEN NULL ELSE k % 4 = 0 END AS has_ebay,
         CASE WHEN k % 9 = 0 THEN NULL ELSE k % 2 = 0 END AS paypal_email_consistency,
         k % 3 AS geo_demerit,
         CASE WHEN k % 6 = 0 THEN NULL ELSE k % 50 END AS linkedin_connections,
         k % 24 AS account_age,
         CASE WHEN k % 21 = 0 THEN NULL ELSE k % 8 = 0 END AS strongly_connected,
         k % 9 AS pays_in_time,
         CASE WHEN k % 13 = 0 THEN NULL ELSE c_acctbal < 2000 END AS is_late,
         CASE WHEN k % 31 = 0 THEN NULL ELSE k % 4 END AS repaid_loans,
         k % 3 AS active_loans
  FROM report_rows)""".replace("{codes}", " ".join(
    ["WHEN 'NATION_0' THEN NULL", *[f"WHEN '{n}' THEN '{v}'" for n, v in NATION_CODES.items()]]))

_DUE = f"""
due AS (SELECT * FROM multi_payments WHERE dtpayment < TIMESTAMP '{AS_OF}'),
status AS (
  SELECT id, loan_id, dtpayment, dtpaid, multi_payment_number,
         CASE WHEN dtpaid IS NOT NULL AND dtpayment >= dtpaid THEN 1 ELSE 0 END AS ontime,
         CASE WHEN dtpaid IS NULL OR dtpayment < dtpaid THEN 1 ELSE 0 END AS late,
         CASE WHEN dtpaid IS NULL THEN 1 ELSE 0 END AS never
  FROM due)"""

_ELIGIBLE = """
eligible AS (
  SELECT * FROM listings
  WHERE payment_type_id IN (4, 5, 6)
    AND id NOT IN (SELECT DISTINCT parent_listing_id FROM listings
                   WHERE parent_listing_id IS NOT NULL))"""

_ELIGIBLE_WEEKLY = """
eligible AS (SELECT * FROM listings WHERE payment_type_id IN (3))"""

_ELIGIBLE_NO_REFINANCING = """
eligible AS (
  SELECT * FROM listings
  WHERE payment_type_id IN (4, 5, 6)
    AND id NOT IN (SELECT DISTINCT parent_listing_id FROM listings
                   WHERE parent_listing_id IS NOT NULL)
    AND (parent_listing_id IS NULL OR parent_listing_id NOT IN (SELECT id FROM listings)))"""

_BORROWERS = """
borrowers AS (
  SELECT l.id AS loan_id, u.country, l.created_at, CAST(l.created_at AS DATE) AS created_day
  FROM loans l
  LEFT JOIN users u ON l.user_id = u.id
  JOIN eligible e ON e.loan_id = l.id
  WHERE l.reimbursed = false)"""

_FACTS = """
facts AS (
  SELECT s.loan_id, b.country, b.created_day, s.dtpayment, s.multi_payment_number,
         s.ontime, s.late, s.never
  FROM status s JOIN borrowers b ON s.loan_id = b.loan_id)"""

def _sql_list(values) -> str:
    return ", ".join(repr(v) for v in dict.fromkeys(values))


_GROUP_SQL = _sql_list(GROUP)


def _with(*parts: str) -> str:
    return "WITH" + ",".join((_BINDINGS,) + parts) + "\n"


_COHORT = (_DUE, _ELIGIBLE, _BORROWERS, _FACTS)


def _daily(day: str, where: str = "TRUE", by: str = "") -> str:
    by_sel = f"{by}, " if by else ""
    return f"""
daily AS (
  SELECT {by_sel}{day} AS day,
         CAST(SUM(ontime) AS BIGINT) AS ontime,
         CAST(SUM(late) AS BIGINT) AS late,
         CAST(SUM(never) AS BIGINT) AS never
  FROM facts_g WHERE {where}
  GROUP BY {by_sel}{day})"""


def _window(days: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    by_sel = f"{by}, " if by else ""
    frame = (f"OVER ({part}ORDER BY date_diff('day', DATE '1970-01-01', day) "
             f"RANGE BETWEEN {days - 1} PRECEDING AND CURRENT ROW)")
    return f"""
SELECT {by_sel}day,
       CAST(w_late AS DOUBLE) * 100.0 / (w_late + w_on) AS late_pct,
       w_late + w_on AS due_total, w_late AS late_total, w_never AS never_total
FROM (SELECT {by_sel}day,
             CAST(SUM(ontime) {frame} AS BIGINT) AS w_on,
             CAST(SUM(late) {frame} AS BIGINT) AS w_late,
             CAST(SUM(never) {frame} AS BIGINT) AS w_never
      FROM daily WHERE day IS NOT NULL AND day <= DATE '{AS_OF_DAY}') w"""


def _facts_g(grouped: bool, group: str = _GROUP_SQL) -> str:
    if not grouped:
        return "\nfacts_g AS (SELECT * FROM facts)"
    return f"""
facts_g AS (
  SELECT *, COALESCE(country IN ({group}), false) AS in_group FROM facts)"""


def _late_ratio_sql(day: str, days: int, by_group: bool = False, group_only: bool = False,
                    eligible: str = _ELIGIBLE, group: str = _GROUP_SQL) -> str:
    by = "in_group" if by_group else ""
    where = "in_group" if group_only else "TRUE"
    cohort = (_DUE, eligible, _BORROWERS, _FACTS)
    return _with(*cohort, _facts_g(by_group, group), _daily(day, where, by)) + _window(days, by)


def _daily_sql(day: str) -> str:
    return (_with(*_COHORT, _facts_g(False), _daily(day))
            + "SELECT *, CAST(ontime AS DOUBLE) * 100.0 / (ontime + late) AS ontime_pct FROM daily")


def _all_payments_sql(windowed: bool) -> str:
    facts_all = "\nfacts_g AS (SELECT * FROM status)"
    body = _with(_DUE, facts_all, _daily("dtpayment"))
    if windowed:
        return body + _window(WINDOW)
    return body + "SELECT *, CAST(ontime AS DOUBLE) * 100.0 / (ontime + late) AS ontime_pct FROM daily"


def _monthly_sql(start: str, day: str = "created_day") -> str:
    periods = f"""
periods AS (
  SELECT CAST(DATE '{start}' + i * INTERVAL 1 MONTH AS DATE) AS period_start,
         CAST(DATE '{start}' + (i + 1) * INTERVAL 1 MONTH AS DATE) AS period_end
  FROM range({MONTHLY_PERIODS}) r(i))"""
    return _with(*_COHORT, periods) + f"""
SELECT period_start AS cohort_start, multi_payment_number, ontime, late, never,
       ontime + late AS due_total,
       CAST(never AS DOUBLE) * 100.0 / (ontime + late) AS never_pct,
       CAST(late AS DOUBLE) * 100.0 / (ontime + late) AS late_pct
FROM (SELECT p.period_start, f.multi_payment_number,
             CAST(SUM(f.ontime) AS BIGINT) AS ontime,
             CAST(SUM(f.late) AS BIGINT) AS late,
             CAST(SUM(f.never) AS BIGINT) AS never
      FROM facts f JOIN periods p
        ON f.{day} >= p.period_start AND f.{day} < p.period_end
      GROUP BY p.period_start, f.multi_payment_number) c"""


def _payback_sql(factor: str, exclude: str = "") -> str:
    # Positive and negative counts separately, then matched back with a
    # full outer join where null matches null, as the analysis did.
    tail = f"WHERE value IS NULL OR value NOT IN ({exclude})" if exclude else ""
    return _with() .rstrip(",\n") + f""",
pos AS (SELECT {factor} AS value, COUNT(*) AS n FROM credit_reports
        WHERE repaid_loans > 0 GROUP BY {factor}),
neg AS (SELECT {factor} AS value, COUNT(*) AS n FROM credit_reports
        WHERE is_late GROUP BY {factor}),
joined AS (
  SELECT COALESCE(pos.value, neg.value) AS value,
         COALESCE(pos.n, 0) AS positive, COALESCE(neg.n, 0) AS negative
  FROM pos FULL OUTER JOIN neg ON pos.value IS NOT DISTINCT FROM neg.value)
SELECT value AS {factor}, positive, negative,
       CAST(negative AS DOUBLE) * 100.0 / (negative + positive) AS late_pct
FROM joined {tail}"""


def _behaviour_rows_sql() -> str:
    return _with().rstrip(",\n") + """,
joined AS (
  SELECT u.bad_behavior, r.id AS report_id, r.repaid_loans
  FROM users u FULL OUTER JOIN credit_reports r ON u.id = r.user_id)"""


def _behaviour_sql(positive: str) -> str:
    pos = ("report_id IS NOT NULL AND repaid_loans > 0" if positive == "repaid"
           else "bad_behavior = false")
    return _behaviour_rows_sql() + f"""
SELECT bad_behavior, positive, negative,
       CAST(negative AS DOUBLE) * 100.0 / (negative + positive) AS late_pct
FROM (SELECT bad_behavior,
             COUNT(*) FILTER (WHERE {pos}) AS positive,
             COUNT(*) FILTER (WHERE bad_behavior) AS negative
      FROM joined GROUP BY bad_behavior) g
WHERE positive + negative > 0"""


def _totals_sql(exclude: str = "", factor: str = "country") -> str:
    keep = f"({factor} IS NULL OR {factor} NOT IN ({exclude}))" if exclude else "TRUE"
    return _with().rstrip(",\n") + f"""
SELECT total_late, total_not_late,
       CASE WHEN total_late + total_not_late = 0 THEN NULL
            ELSE CAST(total_late AS DOUBLE) * 100.0 / (total_late + total_not_late) END AS late_pct,
       negative_customers
FROM (SELECT COUNT(*) FILTER (WHERE is_late AND {keep}) AS total_late,
             COUNT(*) FILTER (WHERE repaid_loans > 0 AND {keep}) AS total_not_late,
             COUNT(*) FILTER (WHERE is_late) AS negative_customers
      FROM credit_reports) t"""


def _all_factors_sql() -> str:
    each = "\nUNION ALL\n".join(
        f"""SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS value, COUNT(*) FILTER (WHERE repaid_loans > 0) AS positive,
       COUNT(*) FILTER (WHERE is_late) AS negative FROM credit_reports GROUP BY {f}""" for f in FACTORS)
    return _with().rstrip(",\n") + f"""
SELECT *, CAST(negative AS DOUBLE) * 100.0 / (negative + positive) AS late_pct
FROM ({each}) a WHERE positive + negative > 0"""


def _positions_sql(sql: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM ({sql}) p"


def _behaviour_totals_sql() -> str:
    return _behaviour_rows_sql() + """
SELECT total_late, total_not_late,
       CASE WHEN total_late + total_not_late = 0 THEN NULL
            ELSE CAST(total_late AS DOUBLE) * 100.0 / (total_late + total_not_late) END AS late_pct,
       total_late AS negative_customers
FROM (SELECT COUNT(*) FILTER (WHERE bad_behavior) AS total_late,
             COUNT(*) FILTER (WHERE report_id IS NOT NULL AND repaid_loans > 0) AS total_not_late
      FROM joined) t"""


def _build_oracle() -> dict[str, str]:
    s: dict[str, str] = {}
    for table in ("users", "loans", "listings", "multi_payments", "credit_reports"):
        s[f"load_{table}"] = _with().rstrip(",\n") + f"\nSELECT * FROM {table}"
    s["due_payments"] = _with(_DUE) + "SELECT * FROM due"
    s["open_loans"] = _with().rstrip(",\n") + "\nSELECT * FROM loans WHERE reimbursed = false"
    s["eligible_listings"] = _with(_ELIGIBLE) + "SELECT * FROM eligible"
    s["eligible_listings_weekly"] = (_with().rstrip(",\n")
                                     + "\nSELECT * FROM listings WHERE payment_type_id IN (3)")
    s["eligible_listings_all_types"] = _with().rstrip(",\n") + "\nSELECT * FROM listings"
    s["eligible_listings_keep_refinanced"] = (
        _with().rstrip(",\n") + "\nSELECT * FROM listings WHERE payment_type_id IN (4, 5, 6)")
    s["eligible_listings_no_refinancing"] = _with().rstrip(",\n") + """
SELECT * FROM listings
WHERE payment_type_id IN (4, 5, 6)
  AND (parent_listing_id IS NULL OR parent_listing_id NOT IN (SELECT id FROM listings))"""
    s["payment_status"] = _with(_DUE) + "SELECT * FROM status"
    s["loan_borrowers"] = _with(_ELIGIBLE, _BORROWERS) + "SELECT * FROM borrowers"
    s["payment_facts"] = _with(*_COHORT) + "SELECT * FROM facts"
    s["daily_counts_created"] = _daily_sql("created_day")
    s["daily_counts_due"] = _daily_sql("dtpayment")
    s["late_ratio_created"] = _late_ratio_sql("created_day", WINDOW)
    s["late_ratio_due"] = _late_ratio_sql("dtpayment", WINDOW)
    s["late_ratio_7d"] = _late_ratio_sql("created_day", 7)
    s["late_ratio_by_group_created"] = _late_ratio_sql("created_day", WINDOW, by_group=True)
    s["late_ratio_by_group_default"] = _late_ratio_sql("created_day", WINDOW, by_group=True,
                                                       group=_sql_list(DEFAULT_GROUP))
    s["late_ratio_by_group_due"] = _late_ratio_sql("dtpayment", WINDOW, by_group=True)
    s["late_ratio_group_only"] = _late_ratio_sql("created_day", WINDOW, True, group_only=True)
    s["late_ratio_all_payments"] = _all_payments_sql(True)
    s["daily_counts_all_payments"] = _all_payments_sql(False)
    s["late_ratio_created_weekly"] = _late_ratio_sql("created_day", WINDOW, eligible=_ELIGIBLE_WEEKLY)
    s["late_ratio_due_salted"] = s["late_ratio_due"]
    s["late_ratio_due_no_refinancing"] = _late_ratio_sql("dtpayment", WINDOW,
                                                         eligible=_ELIGIBLE_NO_REFINANCING)
    s["cohort_total_created"] = s["late_ratio_created"]
    s["cohort_by_group_due"] = s["late_ratio_by_group_due"]
    s["monthly_instalment_cohorts"] = _monthly_sql(MONTHLY_START)
    s["monthly_instalment_cohorts_mid_month"] = _monthly_sql(MONTHLY_START_MID)
    s["monthly_instalment_cohorts_due"] = _monthly_sql(MONTHLY_START, "dtpayment")
    for factor in FACTORS:
        s[f"factor_payback_{factor}"] = _payback_sql(factor)
    s["factor_payback_country_excluding"] = _payback_sql("country", _GROUP_SQL)
    s["factor_payback_country_excluding_developed"] = _payback_sql("country", _sql_list(DEVELOPED_COUNTRIES))
    s["factor_payback_geo_demerit_excluding"] = _payback_sql("geo_demerit", "1, 2")
    s["factor_payback_has_job_excluding"] = _payback_sql("has_job", "true")
    s["behaviour_payback"] = _behaviour_sql("repaid")
    s["behaviour_payback_good"] = _behaviour_sql("good_behaviour")
    s["payback_totals"] = _totals_sql()
    s["payback_totals_excluding"] = _totals_sql(_GROUP_SQL)
    s["payback_totals_geo_demerit_excluding"] = _totals_sql("1, 2", "geo_demerit")
    s["factor_payback_all"] = _all_factors_sql()
    s["late_ratio_created_positions"] = _positions_sql(s["late_ratio_created"], "day")
    s["late_ratio_by_group_positions"] = _positions_sql(s["late_ratio_by_group_created"], "in_group, day")
    s["monthly_cohort_positions"] = _positions_sql(s["monthly_instalment_cohorts"], "cohort_start, multi_payment_number")
    s["factor_payback_country_positions"] = _positions_sql(s["factor_payback_country"], "late_pct, country NULLS FIRST")
    s["behaviour_payback_totals"] = _behaviour_totals_sql()
    return s


QUERIES: dict[str, Query] = _build_queries()
ORACLE_SQL: dict[str, str] = _build_oracle()
FLAGSHIP = "late_ratio_created"
