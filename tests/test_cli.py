"""The command-line jobs read stored loan tables and write their results."""

import os
import tempfile

import pytest

from loanlag import operators as op
from loanlag.__main__ import parser, run, session_conf
from loanlag.plans import factor_report, monthly_report, plan_text
from loanlag.plans.registry import AS_OF, GROUP
from loanlag.sources.schemas import SCHEMAS


@pytest.fixture(scope="module")
def stored(tables):
    """The sf0.01 loan tables written as parquet, one folder per table."""
    root = tempfile.mkdtemp(prefix="loanlag-cli-in-")
    for name in SCHEMAS:
        getattr(tables, name).write.parquet(os.path.join(root, name))
    return root


def _out():
    return tempfile.mkdtemp(prefix="loanlag-cli-out-")


def test_cohort_job(spark, tables, stored):
    out = _out()
    run(spark, ["cohort", "--input", stored, "--out", out, "--as-of", AS_OF,
                "--group", ",".join(GROUP)])
    facts = op.payment_facts(tables, AS_OF, keys=[])
    want = op.group_late_ratio(facts, GROUP, True, "created_day", 30, AS_OF)
    got = spark.read.parquet(os.path.join(out, "by_group"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    total = spark.read.parquet(os.path.join(out, "total"))
    assert total.exceptAll(op.late_ratio(facts, "created_day", 30, AS_OF)).count() == 0


def test_monthly_job(spark, tables, stored):
    out = _out()
    run(spark, ["monthly", "--input", stored, "--out", out, "--as-of", AS_OF,
                "--start", "2000-09-01", "--periods", "6"])
    got = spark.read.parquet(os.path.join(out, "monthly"))
    assert got.count() == 42


def test_factor_and_behaviour_jobs(spark, tables, stored):
    out = _out()
    run(spark, ["factor", "--input", stored, "--out", out, "--factor", "country",
                "--exclude", ",".join(GROUP)])
    assert spark.read.parquet(os.path.join(out, "payback")).count() == 22
    totals = spark.read.parquet(os.path.join(out, "totals")).first()
    assert (totals.total_late, totals.total_not_late, totals.negative_customers) == (383, 1024, 434)
    out = _out()
    run(spark, ["behaviour", "--input", stored, "--out", out, "--positive", "good_behaviour"])
    rows = {r.bad_behavior: (r.positive, r.negative)
            for r in spark.read.parquet(os.path.join(out, "payback")).collect()}
    assert rows == {True: (0, 107), False: (1162, 0)}


def test_monthly_job_by_due_day(spark, tables, stored):
    out = _out()
    run(spark, ["monthly", "--input", stored, "--out", out, "--as-of", AS_OF, "--day", "dtpayment",
                "--start", "2000-09-01", "--periods", "6"])
    got = spark.read.parquet(os.path.join(out, "monthly"))
    want = monthly_report(tables, AS_OF, "2000-09-01", 6, day="dtpayment")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert want.exceptAll(monthly_report(tables, AS_OF, "2000-09-01", 6)).count() > 0


def test_exclusions_follow_the_column_type(spark, stored):
    def kept(factor, exclude):
        out = _out()
        run(spark, ["factor", "--input", stored, "--out", out, "--factor", factor, "--exclude", exclude])
        return {r[0] for r in spark.read.parquet(os.path.join(out, "payback")).collect()}

    assert kept("geo_demerit", "1,2") == {0}
    assert kept("has_job", "true") == {False, None}
    for factor, exclude in (("geo_demerit", "developed"), ("has_job", "maybe")):
        with pytest.raises(ValueError, match="is not a value of type"):
            kept(factor, exclude)


def test_true_equals_one(tables):
    reports = tables.credit_reports
    numbers, flags = op.factor_payback(reports, "geo_demerit"), op.factor_payback(reports, "has_job")
    assert {r[0] for r in op.exclude_values(numbers, [True]).collect()} == {0, 2}
    assert {r[0] for r in op.exclude_values(flags, [1, 7, "x"]).collect()} == {False, None}


def test_jobs_scan_the_reports_once_and_release_what_they_keep(spark, tables):
    report = factor_report(tables.credit_reports, "country", GROUP, cache=True)
    report.table.collect()
    assert "InMemoryTableScan" in plan_text(report.totals, "simple")
    assert report.grouped.storageLevel.useMemory
    report.grouped.unpersist()
    assert not report.grouped.storageLevel.useMemory


def test_one_connection_is_refused_and_sizes_are_applied(spark, stored):
    with pytest.raises(SystemExit, match="at least 2"):
        run(spark, ["factor", "--jdbc-url", "jdbc:none", "--out", "x", "--jdbc-partitions", "1"])
    args = parser().parse_args(["factor", "--out", "x", "--input-gb", "102400", "--cores", "8000"])
    assert session_conf(args)["spark.sql.shuffle.partitions"] == "409600"
    with pytest.raises(SystemExit, match="go together"):
        session_conf(parser().parse_args(["factor", "--out", "x", "--cores", "8000"]))


def test_named_groups_and_defaults():
    args = parser().parse_args(["factor", "--out", "x", "--exclude", "developed"])
    assert args.factor == "country" and args.positive == "repaid"
    from loanlag.__main__ import _values
    from loanlag.presets import DEVELOPED_COUNTRIES
    assert _values("developed") == list(DEVELOPED_COUNTRIES)
    assert _values("A,B") == ["A", "B"]


def test_csv_input_with_reader_options(spark, tables):
    root = tempfile.mkdtemp(prefix="loanlag-cli-csv-")
    for name in SCHEMAS:
        getattr(tables, name).write.option("header", "true").csv(os.path.join(root, name))
    out = _out()
    run(spark, ["factor", "--input", root, "--format", "csv", "--read-option", "header=true",
                "--out", out, "--factor", "account_age"])
    got = spark.read.parquet(os.path.join(out, "payback"))
    want = op.factor_payback(tables.credit_reports, "account_age")
    assert got.count() == 24 and got.exceptAll(want).count() == 0
