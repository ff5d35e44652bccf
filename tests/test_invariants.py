"""Invariants that hold on any input, checked on the sf0.01 fixture."""

from pyspark.sql import functions as F

from loanlag import operators as op
from loanlag.plans import cohort_late_ratios, monthly_report
from loanlag.plans.registry import AS_OF, GROUP

A = F.col


def test_each_payment_is_ontime_or_late(tables):
    facts = op.payment_facts(tables, AS_OF)
    bad = facts.where((A("ontime") + A("late") != 1) | (A("never") > A("late"))).count()
    assert bad == 0


def test_presummed_facts_equal_detail_facts(tables):
    detail = op.payment_facts(tables, AS_OF)
    for keys, day in (([], "created_day"), (["dtpayment"], "dtpayment")):
        summed = op.payment_facts(tables, AS_OF, keys=keys)
        a = op.daily_counts(detail, day).exceptAll(op.daily_counts(summed, day)).count()
        assert a == 0


def test_without_country_keeps_every_fact(tables):
    a = op.payment_facts(tables, AS_OF, keys=[]).agg(F.sum("late")).first()[0]
    b = op.payment_facts(tables, AS_OF, keys=[], with_country=False).agg(F.sum("late")).first()[0]
    assert a == b


def test_group_and_rest_add_up_to_total(tables):
    facts = op.payment_facts(tables, AS_OF, keys=[])
    by = op.group_late_ratio(facts, GROUP, True, "created_day", 1, AS_OF)
    total = op.late_ratio(facts, "created_day", 1, AS_OF)
    summed = by.groupBy("day").agg(F.sum("due_total").alias("due_total"),
                                   F.sum("late_total").alias("late_total"),
                                   F.sum("never_total").alias("never_total"))
    assert summed.exceptAll(total.select("day", "due_total", "late_total", "never_total")).count() == 0


def test_one_day_window_is_daily_counts(tables):
    facts = op.payment_facts(tables, AS_OF, keys=[])
    daily = op.daily_counts(facts.where(A("created_day") <= "2001-06-30"), "created_day")
    one = op.late_ratio(facts, "created_day", 1, AS_OF)
    joined = one.join(daily, "day")
    assert joined.count() == one.count() == daily.count()
    assert joined.where((A("due_total") != A("ontime") + A("late"))
                        | (A("late_total") != A("late"))).count() == 0


def test_block_size_does_not_change_the_window(tables):
    facts = op.payment_facts(tables, AS_OF, keys=["dtpayment"])
    daily = op.daily_counts(facts, "dtpayment")
    a = op.trailing_late_ratio(daily, 30, as_of=AS_OF, block_days=45)
    b = op.trailing_late_ratio(daily, 30, as_of=AS_OF, block_days=100_000)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_pipeline_series_match_operator_series(tables):
    series = cohort_late_ratios(tables, AS_OF, values=GROUP)
    facts = op.payment_facts(tables, AS_OF, keys=[])
    assert series.total.exceptAll(op.late_ratio(facts, "created_day", 30, AS_OF)).count() == 0
    assert series.by_group.exceptAll(
        op.group_late_ratio(facts, GROUP, True, "created_day", 30, AS_OF)).count() == 0


def test_checkpointed_pipeline_matches(tables):
    a = cohort_late_ratios(tables, AS_OF, values=GROUP, checkpoint=True)
    b = cohort_late_ratios(tables, AS_OF, values=GROUP)
    assert a.total.exceptAll(b.total).count() == 0
    assert a.by_group.exceptAll(b.by_group).count() == 0


def test_monthly_counts_cover_the_facts_in_span(tables):
    out = monthly_report(tables, AS_OF, "2000-09-01", 6)
    facts = op.payment_facts(tables, AS_OF).where(
        (A("created_day") >= "2000-09-01") & (A("created_day") < "2001-03-01"))
    want = facts.agg(F.sum("ontime"), F.sum("late"), F.sum("never")).first()
    got = out.agg(F.sum("ontime"), F.sum("late"), F.sum("never")).first()
    assert tuple(want) == tuple(got)
    assert out.where(A("due_total") != A("ontime") + A("late")).count() == 0


def test_factor_tables_count_every_flag(tables):
    reports = tables.credit_reports
    want = reports.agg(F.count_if(A("repaid_loans") > 0), F.count_if(A("is_late"))).first()
    from loanlag.presets import FACTORS
    for factor in FACTORS:
        got = op.factor_payback(reports, factor).agg(F.sum("positive"), F.sum("negative")).first()
        assert tuple(got) == tuple(want), factor


def test_null_spread_join_matches_plain_anti_join(tables):
    listings = tables.listings
    known = listings.select(A("id").alias("_known_id"))
    a = op.anti_join_nullable(listings, known, "parent_listing_id", "_known_id")
    b = listings.join(known, listings["parent_listing_id"] == known["_known_id"], "left_anti")
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_pipeline_group_only_matches_operator(tables):
    series = cohort_late_ratios(tables, AS_OF, day="dtpayment", values=GROUP, include_rest=False)
    facts = op.payment_facts(tables, AS_OF, keys=["dtpayment"])
    want = op.group_late_ratio(facts, GROUP, False, "dtpayment", 30, AS_OF)
    assert series.by_group.count() == want.count() > 0
    assert series.by_group.exceptAll(want).count() == 0
