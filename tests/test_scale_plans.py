"""The plan shapes a large cluster gets, checked for correctness on small data.

At sf0.01 every join side is small and Spark broadcasts it.  At scale the
same queries run as shuffled sort-merge joins (with the null-spread keys,
anti joins and the full outer join shuffled on both sides).  Here broadcasts
are switched off, static and adaptive, and skew splitting is forced on tiny
partitions, so those plans run and must still match the DuckDB oracle.
"""

import contextlib

import pytest

import __spark_entry__ as entry
from loanlag.plans import plan_text
from tests.conftest import SF001
from tests.oracle import compare

QUERIES = entry.queries()
SQL = entry.oracle_sql()

AT_SCALE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
}

JOIN_HEAVY = [
    "eligible_listings", "eligible_listings_no_refinancing", "loan_borrowers", "payment_facts",
    "late_ratio_created", "late_ratio_by_group_due", "cohort_by_group_due",
    "monthly_instalment_cohorts", "behaviour_payback", "behaviour_payback_good",
    "behaviour_payback_totals", "payback_totals_excluding",
]


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("name", JOIN_HEAVY)
def test_shuffled_plans_match_oracle(spark, duck, name):
    with conf(spark, AT_SCALE):
        lines = plan_text(QUERIES[name](spark, SF001), "simple").splitlines()
        # only bounded sides keep a broadcast: the fixed 25-row nation table
        # and hot-key lists (fewer than HOT_KEY_BOUND rows by arithmetic)
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = " ".join(lines[i + 1:i + 4])
                assert "n_nationkey" in below or "_buckets" in below
        res = compare(spark, duck, name, QUERIES[name], SQL[name], SF001)
    assert res["ok"], res["problems"]


def test_shuffled_borrowers_use_sort_merge_joins(spark):
    with conf(spark, AT_SCALE):
        text = plan_text(QUERIES["loan_borrowers"](spark, SF001))
    assert "SortMergeJoin LeftOuter" in text and "SortMergeJoin Inner" in text


def test_monthly_span_prunes_payments_before_the_shuffle(spark):
    # with the cluster's thresholds the six months of loans build a bloom
    # filter that is applied in the payments scan, below the partial aggregate
    with conf(spark, {**AT_SCALE,
                      "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
                      "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256m"}):
        text = plan_text(QUERIES["monthly_instalment_cohorts"](spark, SF001), "simple")
    scan_filter = [l for l in text.splitlines() if "might_contain" in l and "l_shipdate" in l]
    assert scan_filter


def test_loan_side_prunes_due_payments_before_the_shuffle(spark):
    with conf(spark, {**AT_SCALE,
                      "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
                      "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256m"}):
        text = plan_text(QUERIES["late_ratio_due"](spark, SF001), "simple")
    assert [l for l in text.splitlines() if "might_contain" in l and "l_shipdate" in l]


def test_hot_loans_are_counted_without_a_window_over_all_keys(spark):
    text = plan_text(QUERIES["late_ratio_due_salted"](spark, SF001), "simple")
    assert "Window [sum(_rows" not in text


# Shuffles per query in the at-scale shape.  late_ratio_created: payments
# (partial-summed, by loan), loans (by loan), listings (by id, for the anti
# join), parent ids (partial distinct, by id), eligible listings (by loan),
# daily counts (partial, by day), window blocks.  The payments, the largest
# table, cross the network once.  Due-day series also cross it once, and add
# the loan side's own shuffle, without which AQE could not split a hot loan.
# The monthly report pre-sums per (loan,
# instalment) after a bloom-filtered scan.  Grouped series add the users
# join; payback tables shuffle only partial aggregates.
EXCHANGES = {
    "late_ratio_created": 7,
    "late_ratio_due": 8,
    "late_ratio_by_group_due": 10,
    "monthly_instalment_cohorts": 7,
    "daily_counts_all_payments": 1,
    "factor_payback_country": 1,
    "payback_totals": 2,
    "behaviour_payback": 3,
}


@pytest.mark.parametrize("name", sorted(EXCHANGES))
def test_shuffle_count(spark, name):
    from loanlag.plans import exchange_count

    with conf(spark, AT_SCALE):
        assert exchange_count(QUERIES[name](spark, SF001)) == EXCHANGES[name]


def test_cluster_settings_broadcast_only_after_measurement(spark):
    from loanlag.session import cluster_conf

    settings = {k: v for k, v in cluster_conf(10 * 2**30, 8).items()
                if "autoBroadcastJoinThreshold" in k}
    with conf(spark, settings):
        df = QUERIES["late_ratio_created"](spark, SF001)
        assert len(df.collect()) > 0  # runs this DataFrame's own adaptive plan
        text = plan_text(df, "simple")
    final, initial = text.split("Initial Plan")
    assert "BroadcastHashJoin" not in initial  # nothing broadcast on estimates
    assert "BroadcastHashJoin" in final        # small sides broadcast once measured
