"""Brute-force checks of the window blocking and the month index."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanlag import operators as op
from loanlag.functions import month_index, period_bounds

BASE = dt.date(2014, 12, 20)

daily_rows = st.lists(
    st.tuples(st.integers(0, 800), st.integers(0, 5), st.integers(0, 5), st.integers(0, 5)),
    min_size=1, max_size=40, unique_by=lambda r: r[0])


def brute_force(rows, days):
    out = {}
    for d, *_ in rows:
        window = [r for r in rows if d - days < r[0] <= d]
        on = sum(r[1] for r in window)
        late = sum(r[2] for r in window)
        never = sum(min(r[3], r[2]) for r in window)
        out[BASE + dt.timedelta(days=d)] = (on + late, late, never)
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=daily_rows, days=st.integers(1, 120), block=st.integers(1, 400))
def test_blocked_window_equals_brute_force(spark, rows, days, block):
    data = [(BASE + dt.timedelta(days=d), on, late, min(never, late)) for d, on, late, never in rows]
    daily = spark.createDataFrame(data, "day date, ontime long, late long, never long")
    got = {r.day: (r.due_total, r.late_total, r.never_total)
           for r in op.trailing_late_ratio(daily, days, block_days=block).collect()}
    assert got == brute_force(rows, days)


def _period_of(day, bounds):
    for i in range(len(bounds) - 1):
        if bounds[i] <= day < bounds[i + 1]:
            return bounds[i]
    return None


def test_month_index_equals_period_search(spark):
    days = spark.range(0, 1200).select(
        F.date_add(F.lit(dt.date(2013, 11, 1)), F.col("id").cast("int")).alias("day"))
    for start in (dt.date(2014, 1, 1), dt.date(2014, 1, 15), dt.date(2014, 3, 28),
                  dt.date(2014, 11, 28), dt.date(2014, 12, 5)):
        bounds = period_bounds(start, 14)
        idx = month_index(F.col("day"), start)
        rows = days.select("day", F.when((idx >= 0) & (idx < 14),
                                         F.add_months(F.lit(start), idx)).alias("cohort")).collect()
        for r in rows:
            assert r.cohort == _period_of(r.day, bounds), (start, r.day)


keyed_rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.integers(0, 1000)),
                      max_size=40)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(big=keyed_rows, small=keyed_rows, hot=st.sets(st.integers(0, 8), max_size=4),
       buckets=st.integers(1, 9))
def test_salted_join_equals_plain_join(spark, big, small, hot, buckets):
    from loanlag.operators.joins import salted_join

    b = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(big)], "k long, v long, i long")
    s = spark.createDataFrame(small, "k long, w long")
    h = spark.createDataFrame([(k, buckets + k) for k in sorted(hot)], "k long, _buckets int")
    got = sorted(map(tuple, salted_join(b, s, "k", h, ["i", "v"]).select("k", "v", "i", "w").collect()))
    want = sorted((bk, bv, i, sw) for i, (bk, bv) in enumerate(big) for sk, sw in small
                  if bk is not None and bk == sk)
    assert got == want


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=keyed_rows, right=keyed_rows)
def test_null_spread_joins_equal_plain_joins(spark, left, right):
    from loanlag.operators.joins import anti_join_nullable, left_join_nullable

    l = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(left)], "k long, v long, i long")
    r = spark.createDataFrame(right, "rk long, w long")
    anti = sorted(map(tuple, anti_join_nullable(l, r.select("rk"), "k", "rk").collect()),
                  key=repr)
    want_anti = sorted(map(tuple, l.join(r, l["k"] == r["rk"], "left_anti").collect()), key=repr)
    assert anti == want_anti
    outer = sorted(map(tuple, left_join_nullable(l, r, "k", "rk", ["i"])
                       .select("k", "v", "i", "w").collect()), key=repr)
    want_outer = sorted(map(tuple, l.join(r, l["k"] == r["rk"], "left")
                            .select("k", "v", "i", "w").collect()), key=repr)
    assert outer == want_outer
