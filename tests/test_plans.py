"""Physical-plan checks: no Python hop, no all-pairs join, pushdown, pruning."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loanlag import operators as op
from loanlag.plans import plan_problems, plan_text, scanned_columns
from loanlag.plans.registry import AS_OF
from loanlag.sources import read_table
from tests.conftest import SF001

QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_or_pairwise_operators(spark, name):
    assert plan_problems(QUERIES[name](spark, SF001)) == []


def test_refinanced_listings_use_an_anti_join(tables):
    assert "LeftAnti" in plan_text(op.eligible_listings(tables.listings))


def test_window_runs_on_aggregated_days(tables):
    text = plan_text(op.late_ratio(op.payment_facts(tables, AS_OF, keys=[]), "created_day", 30, AS_OF))
    tree = text.split("\n\n")[0]
    assert tree.index("Window") < tree.index("HashAggregate")


def test_payments_are_summed_before_the_join(tables):
    facts = op.payment_facts(tables, AS_OF, keys=[], with_country=False)
    tree = plan_text(facts).split("\n\n")[0]
    # the join sits above the per-loan aggregate of the payments
    join_at = min(tree.index(j) for j in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")
                  if j in tree)
    assert join_at < tree.index("HashAggregate")


def test_columns_are_pruned_at_the_scan(spark):
    df = QUERIES["factor_payback_country"](spark, SF001)
    scans = scanned_columns(df)
    customer = [cols for cols in scans if "c_custkey" in cols]
    assert customer and all("c_name" not in cols and "c_mktsegment" not in cols for cols in customer)


def test_due_date_filter_reaches_a_date_column_scan(spark, tables):
    out = os.path.join(tempfile.mkdtemp(prefix="loanlag-scan-"), "multi_payments")
    tables.multi_payments.write.parquet(out)
    payments = read_table(spark, "multi_payments", out)
    text = plan_text(op.due_payments(payments, AS_OF))
    assert "PushedFilters: [IsNotNull(dtpayment), LessThanOrEqual(dtpayment,2001-06-30)]" in text


def test_creation_bound_reaches_the_loans_scan(tables):
    facts = op.payment_facts(tables, AS_OF, keys=[], with_country=False)
    text = plan_text(facts.where(F.col("created_day") <= "2001-06-30"))
    assert "LessThan(o_orderdate,2001-07-01T00:00)" in text


def test_listings_are_counted_per_loan_before_the_shuffle(tables):
    import re

    lines = plan_text(op.payment_facts(tables, AS_OF, keys=[]), "simple").splitlines()
    partial = [i for i, l in enumerate(lines)
               if re.search(r"HashAggregate\(keys=\[loan_id#\d+L\], functions=\[partial_count", l)]
    assert partial and "Exchange hashpartitioning(loan_id" in lines[partial[0] - 1]


def test_all_factors_come_from_one_scan(spark):
    from loanlag.operators import all_factor_payback, factor_payback
    from loanlag.presets import FACTORS
    from loanlag.plans import exchange_count
    from loanlag.sources import load_fixture

    reports = load_fixture(spark, SF001).credit_reports
    table = all_factor_payback(reports)
    # The fixture joins customers to nations, twice as rows; the table adds one exchange and no scan.
    assert plan_text(table).count("Scan parquet") == plan_text(reports).count("Scan parquet")
    assert exchange_count(table) == exchange_count(reports) + 1
    rows = {(r.factor, r.value): (r.positive, r.negative) for r in table.collect()}
    for factor in FACTORS:
        each = {(factor, None if r[0] is None else str(r[0]).lower() if isinstance(r[0], bool) else str(r[0])): (r.positive, r.negative) for r in factor_payback(reports, factor).collect()}
        assert each == {k: v for k, v in rows.items() if k[0] == factor}
    assert {r.factor for r in all_factor_payback(reports, ["Gender"]).collect()} == {"gender"}


def test_a_loaded_table_that_ran_leaves_the_shared_plan_unrun(spark):
    from loanlag.sources import load_fixture

    for name in ("users", "credit_reports"):
        QUERIES[f"load_{name}"](spark, SF001).collect()
        assert "isFinalPlan=true" not in plan_text(getattr(load_fixture(spark, SF001), name))
