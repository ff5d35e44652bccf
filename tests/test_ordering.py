"""Positions against sorting in plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from loanlag.operators import cohort_positions, day_positions, payback_positions, with_position
from loanlag.plans import plan_text


def test_days_by_group(spark):
    rng = random.Random(3)
    rows = list({(rng.random() < 0.5, dt.date(1999, 1, 1) + dt.timedelta(days=rng.randrange(2000))): None for _ in range(300)})
    found = day_positions(spark.createDataFrame(rows, "in_group boolean, day date").repartition(7)).collect()
    assert [tuple(r)[:2] for r in sorted(found, key=lambda r: r.position)] == sorted(rows)
    assert sorted(r.position for r in found) == list(range(1, len(rows) + 1))
    alone = day_positions(spark.createDataFrame([(d,) for _, d in rows], "day date").distinct()).collect()
    assert [r.day for r in sorted(alone, key=lambda r: r.position)] == sorted({d for _, d in rows})


def test_cohorts_and_paybacks(spark):
    rows = [(dt.date(2014, m, 1), k) for m in (9, 10, 12) for k in (3, 1, 2, None)]
    found = cohort_positions(spark.createDataFrame(rows, "cohort_start date, multi_payment_number int")).collect()
    assert [tuple(r)[:2] for r in sorted(found, key=lambda r: r.position)] == sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1]))
    rows = [("b", 50.0), (None, 50.0), ("a", 50.0), ("c", 0.0), ("d", 99.9), ("e", 100.0), ("f", 0.4)]
    found = payback_positions(spark.createDataFrame(rows, "country string, late_pct double")).collect()
    assert [r.country for r in sorted(found, key=lambda r: r.position)] == ["c", "f", None, "a", "b", "d", "e"]


def test_empty_tables_and_null_ranges(spark):
    assert with_position(spark.createDataFrame([], "x int"), ["x"], F.col("x")).count() == 0
    found = with_position(spark.createDataFrame([(2,), (None,), (1,)], "x int"), ["x"], F.col("x")).collect()
    assert sorted((r.position, r.x) for r in found) == [(1, None), (2, 1), (3, 2)]


def test_no_task_orders_the_whole_table(spark):
    text = plan_text(with_position(spark.range(100).withColumnRenamed("id", "x"), ["x"], F.col("x") / 10), "simple")
    # Only the counts of ranges meet in one partition.
    assert text.count("SinglePartition") == 1 and "rangepartitioning" not in text
