"""Tables stored by loan: same answers, and no shuffle of payments or loans."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from loanlag import operators as op
from loanlag.plans import plan_text
from loanlag.plans.registry import AS_OF
from loanlag.sources import read_colocated, write_colocated
from tests.test_scale_plans import AT_SCALE, conf


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    prefix = f"t{uuid.uuid4().hex}_"
    write_colocated(tables, 8, str(tmp_path_factory.mktemp("colocated")), prefix)
    yield read_colocated(spark, tables, prefix)
    for name in ("multi_payments", "loans", "listings"):
        spark.sql(f"DROP TABLE {prefix}{name}")


def by_day(facts, day):
    return sorted(map(tuple, facts.groupBy(day).agg(*[F.sum(c) for c in ("ontime", "late", "never")]).collect()), key=str)


def exchanged(df):
    """Keys of all shuffles below the final aggregation."""
    return [m for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_text(df, "simple"))]


def test_due_days(spark, tables, stored):
    with conf(spark, AT_SCALE):
        facts = op.payment_facts(stored, AS_OF, keys=["dtpayment"], with_country=False, colocated=True)
        assert by_day(facts, "dtpayment") == by_day(op.payment_facts(tables, AS_OF, keys=["dtpayment"], with_country=False), "dtpayment")
        # What is left: the refinanced listings, found by listing id, and the few eligible listings taken back to their loans.
        assert not [k for k in exchanged(facts) if "_one" in k or "_salt" in k]
        assert "Bucketed: true" in plan_text(facts)
    everything = op.payment_facts(stored, AS_OF, keys=["dtpayment"], with_country=False, colocated=True, payment_types=None, exclude_refinanced=False)
    with conf(spark, AT_SCALE):
        assert exchanged(everything) == []


def test_created_days(spark, tables, stored):
    with conf(spark, AT_SCALE):
        facts = op.payment_facts(stored, AS_OF, keys=[], with_country=False, payment_types=None, exclude_refinanced=False)
        assert exchanged(facts) == []
        plain = op.payment_facts(tables, AS_OF, keys=[], with_country=False, payment_types=None, exclude_refinanced=False)
        assert len(exchanged(plain)) == 3
        assert by_day(facts, "created_day") == by_day(plain, "created_day")


def test_buckets_must_be_positive(tables):
    with pytest.raises(ValueError):
        write_colocated(tables, 0, "unused")
