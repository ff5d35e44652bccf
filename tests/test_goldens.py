"""Hand-worked cases, independent of any SQL engine."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loanlag import operators as op
from loanlag.sources.schemas import CREDIT_REPORTS, LISTINGS, USERS

D = dt.date


def _daily(spark, rows):
    return spark.createDataFrame(rows, "day date, ontime long, late long, never long")


def test_payment_status_flags(spark):
    rows = [(1, 7, D(2015, 1, 10), D(2015, 1, 9), 1),
            (2, 7, D(2015, 1, 10), D(2015, 1, 10), 2),
            (3, 7, D(2015, 1, 10), D(2015, 1, 11), 3),
            (4, 7, D(2015, 1, 10), None, 4)]
    df = spark.createDataFrame(
        rows, "id long, loan_id long, dtpayment date, dtpaid date, multi_payment_number int")
    got = {r.id: (r.ontime, r.late, r.never) for r in op.payment_status(df).collect()}
    assert got == {1: (1, 0, 0), 2: (1, 0, 0), 3: (0, 1, 0), 4: (0, 1, 1)}


WINDOW_INPUT = [(D(2015, 1, 1), 3, 1, 0), (D(2015, 1, 15), 1, 1, 1), (D(2015, 1, 30), 2, 2, 0),
                (D(2015, 1, 31), 0, 1, 1), (D(2015, 3, 15), 1, 0, 0)]


@pytest.mark.parametrize("block_days", [1, 2, 7, 31, 366, 100_000])
def test_trailing_window_30_days(spark, block_days):
    out = op.trailing_late_ratio(_daily(spark, WINDOW_INPUT), 30, block_days=block_days)
    got = {r.day: (r.due_total, r.late_total, r.never_total, round(r.late_pct, 6))
           for r in out.collect()}
    assert got == {
        D(2015, 1, 1): (4, 1, 0, 25.0),
        D(2015, 1, 15): (6, 2, 1, 33.333333),
        D(2015, 1, 30): (10, 4, 1, 40.0),  # 01-01 is 29 days back: still in
        D(2015, 1, 31): (7, 4, 2, 57.142857),  # 01-01 is 30 days back: out
        D(2015, 3, 15): (1, 0, 0, 0.0),  # no rows for the gap days
    }


@pytest.mark.parametrize("block_days", [1, 366])
def test_trailing_window_one_day_is_the_daily_ratio(spark, block_days):
    out = op.trailing_late_ratio(_daily(spark, WINDOW_INPUT), 1, block_days=block_days)
    got = {r.day: r.late_pct for r in out.collect()}
    assert got == {D(2015, 1, 1): 25.0, D(2015, 1, 15): 50.0, D(2015, 1, 30): 50.0,
                   D(2015, 1, 31): 100.0, D(2015, 3, 15): 0.0}


def test_trailing_window_as_of_and_null_day(spark):
    rows = WINDOW_INPUT + [(None, 5, 5, 5)]
    out = op.trailing_late_ratio(_daily(spark, rows), 30, as_of="2015-01-30 08:00:00")
    assert sorted(r.day for r in out.collect()) == [D(2015, 1, 1), D(2015, 1, 15), D(2015, 1, 30)]


def test_trailing_window_rejects_zero_days(spark):
    with pytest.raises(ValueError):
        op.trailing_late_ratio(_daily(spark, WINDOW_INPUT), 0)


def test_group_split_null_is_out_of_group(spark):
    facts = spark.createDataFrame(
        [("A", D(2015, 1, 1), 1, 0, 0), ("B", D(2015, 1, 1), 0, 1, 0),
         (None, D(2015, 1, 1), 0, 1, 1)],
        "country string, created_day date, ontime int, late int, never int")
    out = op.group_late_ratio(facts, ["A"], True, "created_day", 30)
    got = {r.in_group: (r.due_total, r.late_total, r.never_total) for r in out.collect()}
    assert got == {True: (1, 0, 0), False: (2, 2, 1)}
    only = op.group_late_ratio(facts, ["A"], False, "created_day", 30)
    assert [r.in_group for r in only.collect()] == [True]


def _reports(spark, rows):
    cols = {f.name: None for f in CREDIT_REPORTS.fields}
    data = []
    for i, (country, repaid, late, user) in enumerate(rows):
        data.append(Row(**{**cols, "id": i, "user_id": user, "country": country,
                           "repaid_loans": repaid, "is_late": late}))
    return spark.createDataFrame(data, CREDIT_REPORTS)


def test_factor_payback_null_group_and_absent_value(spark):
    reports = _reports(spark, [("A", 1, True, 1), ("A", 0, False, 2), (None, 2, None, 3),
                               (None, 0, True, 4), ("B", 0, False, 5)])
    got = {r.country: (r.positive, r.negative, r.late_pct)
           for r in op.factor_payback(reports, "country").collect()}
    assert got == {"A": (1, 1, 50.0), None: (1, 1, 50.0)}


def test_exclude_values_keeps_null_and_other_types(spark):
    reports = _reports(spark, [("A", 1, True, 1), (None, 2, None, 3), ("US", 1, False, 4)])
    table = op.factor_payback(reports, "country")
    kept = {r.country for r in op.exclude_values(table, ["US", 1, True], "country").collect()}
    assert kept == {"A", None}


def test_payback_totals(spark):
    reports = _reports(spark, [("A", 1, True, 1), ("A", 0, False, 2), (None, 2, None, 3),
                               (None, 0, True, 4), ("B", 0, True, 5)])
    table = op.factor_payback(reports, "country")
    t = op.payback_totals(table, ["B"], "country").collect()[0]
    assert (t.total_late, t.total_not_late, t.negative_customers) == (2, 2, 3)
    assert t.late_pct == 50.0


def test_payback_totals_empty_table(spark):
    table = op.factor_payback(_reports(spark, [("A", 0, False, 1)]), "country")
    t = op.payback_totals(table).collect()[0]
    assert (t.total_late, t.total_not_late, t.late_pct, t.negative_customers) == (0, 0, None, 0)


def test_behaviour_payback_full_join_rules(spark):
    users = spark.createDataFrame([(1, "X", True), (2, "X", False), (3, "X", None), (4, "X", True)],
                                  USERS)
    reports = _reports(spark, [("A", 1, None, 1), ("A", 0, None, 1), ("A", 2, None, 2),
                               ("A", 3, None, None), ("A", 0, None, 9)])
    got = {r.bad_behavior: (r.positive, r.negative, r.late_pct)
           for r in op.behaviour_payback(users, reports).collect()}
    assert got == {True: (1, 3, 75.0), False: (1, 0, 0.0), None: (1, 0, 0.0)}
    good = {r.bad_behavior: (r.positive, r.negative)
            for r in op.behaviour_payback(users, reports, "good_behaviour").collect()}
    assert good == {True: (0, 3), False: (1, 0)}


def test_eligible_listing_variants(spark):
    listings = spark.createDataFrame(
        [(1, 1, 11, 4, None), (2, 1, 12, 5, 1), (3, 1, 13, 3, None), (4, 1, 14, 6, 99),
         (5, 1, 15, 4, 3)], LISTINGS)

    def ids(df):
        return sorted(r.id for r in df.collect())

    assert ids(op.eligible_listings(listings)) == [2, 4, 5]
    assert ids(op.eligible_listings(listings, exclude_refinanced=False)) == [1, 2, 4, 5]
    assert ids(op.eligible_listings(listings, exclude_refinanced=False,
                                    exclude_refinancing=True)) == [1, 4]
    assert ids(op.eligible_listings(listings, (3,), exclude_refinanced=False)) == [3]
    assert ids(op.eligible_listings(listings, None, exclude_refinanced=False)) == [1, 2, 3, 4, 5]
    assert op.eligible_listings(listings).columns == listings.columns


def test_due_payments_includes_as_of_day_after_midnight(spark):
    df = spark.createDataFrame([(1, 1, D(2015, 1, 9)), (2, 1, D(2015, 1, 10)), (3, 1, D(2015, 1, 11))],
                               "id long, loan_id long, dtpayment date")
    assert sorted(r.id for r in op.due_payments(df, "2015-01-10 12:00:00").collect()) == [1, 2]
    assert sorted(r.id for r in op.due_payments(df, "2015-01-10").collect()) == [1]
    assert sorted(r.id for r in op.due_payments(df, dt.datetime(2015, 1, 10, 0, 0, 1)).collect()) == [1, 2]


def test_open_loans_drops_null_reimbursed(spark):
    df = spark.createDataFrame([(1, 1, None, False), (1, 2, None, True), (1, 3, None, None)],
                               "user_id long, id long, created_at timestamp_ntz, reimbursed boolean")
    assert [r.id for r in op.open_loans(df).collect()] == [1]


def test_monthly_periods_same_day_of_month(spark):
    facts = spark.createDataFrame(
        [(D(2014, 1, 14), 1), (D(2014, 1, 15), 1), (D(2014, 2, 14), 1), (D(2014, 2, 15), 1),
         (D(2014, 3, 14), 2), (D(2014, 3, 15), 1)],
        "created_day date, multi_payment_number int").withColumns(
        {"ontime": F.lit(1), "late": F.lit(0), "never": F.lit(0)})
    out = op.monthly_instalment_cohorts(facts, "2014-01-15", 2)
    got = sorted((r.cohort_start, r.multi_payment_number, r.ontime) for r in out.collect())
    assert got == [(D(2014, 1, 15), 1, 2), (D(2014, 2, 15), 1, 1), (D(2014, 2, 15), 2, 1)]


def test_monthly_periods_cross_year_and_reject_missing_day(spark):
    facts = spark.createDataFrame([(D(2014, 12, 31), 1), (D(2015, 1, 5), 1)],
                                  "created_day date, multi_payment_number int").withColumns(
        {"ontime": F.lit(0), "late": F.lit(1), "never": F.lit(1)})
    out = op.monthly_instalment_cohorts(facts, "2014-12-05", 2).collect()
    assert sorted((r.cohort_start, r.never_pct) for r in out) == [
        (D(2014, 12, 5), 100.0), (D(2015, 1, 5), 100.0)]
    with pytest.raises(ValueError):
        op.monthly_instalment_cohorts(facts, "2014-01-30", 2)


def test_output_orderings(spark):
    series = op.trailing_late_ratio(_daily(spark, list(reversed(WINDOW_INPUT))), 30)
    days = [r.day for r in op.in_day_order(series).collect()]
    assert days == sorted(days)
    reports = _reports(spark, [("A", 1, True, 1), ("B", 3, True, 2), (None, 0, True, 3), ("C", 1, False, 4)])
    table = op.by_late_pct(op.factor_payback(reports, "country"))
    assert [r.country for r in table.collect()] == ["C", "A", "B", None]
    facts = spark.createDataFrame([(D(2014, 2, 20), 2), (D(2014, 1, 20), 3), (D(2014, 1, 20), 1)],
                                  "created_day date, multi_payment_number int").withColumns(
        {"ontime": F.lit(1), "late": F.lit(0), "never": F.lit(0)})
    report = op.in_cohort_order(op.monthly_instalment_cohorts(facts, "2014-01-15", 2))
    assert [(r.cohort_start, r.multi_payment_number) for r in report.collect()] == [
        (D(2014, 1, 15), 1), (D(2014, 1, 15), 3), (D(2014, 2, 15), 2)]


def test_membership_follows_python_in(spark):
    from loanlag.functions import in_values

    df = spark.createDataFrame([("A",), ("None",), (None,)], "c string")
    flags = lambda vals: [r.f for r in df.select(in_values(F.col("c"), vals).alias("f")).collect()]
    assert flags(["A"]) == [True, False, False]
    assert flags(["None"]) == [False, True, False]
    assert flags([None]) == [False, False, True]
    assert flags([]) == [False, False, False]
