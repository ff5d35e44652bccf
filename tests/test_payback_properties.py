"""Payback tables on random reports against plain-Python counting."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from loanlag import operators as op
from loanlag.sources.schemas import CREDIT_REPORTS, USERS

SETTINGS = settings(max_examples=20, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

report = st.tuples(
    st.sampled_from(["A", "B", "C", None]),          # country
    st.one_of(st.none(), st.integers(0, 3)),          # repaid_loans
    st.sampled_from([True, False, None]),             # is_late
    st.one_of(st.none(), st.integers(1, 6)),          # user_id (7+ never exists)
)


def _reports_df(spark, rows):
    blank = {f.name: None for f in CREDIT_REPORTS.fields}
    return spark.createDataFrame(
        [Row(**{**blank, "id": i, "country": c, "repaid_loans": r, "is_late": l, "user_id": u})
         for i, (c, r, l, u) in enumerate(rows)], CREDIT_REPORTS)


def _table(rows):
    return {k: (p, n) for k, (p, n) in rows.items() if p + n > 0}


@SETTINGS
@given(rows=st.lists(report, max_size=30))
def test_factor_payback_counts(spark, rows):
    pos, neg = Counter(), Counter()
    for country, repaid, late, _ in rows:
        pos[country] += int(repaid is not None and repaid > 0)
        neg[country] += int(late is True)
    want = _table({k: (pos[k], neg[k]) for k in set(pos) | set(neg)})
    got = {r.country: (r.positive, r.negative)
           for r in op.factor_payback(_reports_df(spark, rows), "country").collect()}
    assert got == want


@SETTINGS
@given(rows=st.lists(report, max_size=30),
       users=st.dictionaries(st.integers(1, 6), st.sampled_from([True, False, None]), max_size=6))
def test_behaviour_payback_counts(spark, rows, users):
    # Every (user, report) pair with matching ids, every user without a
    # report and every report without a user is one row of the join.
    joined = []
    for uid, flag in users.items():
        mine = [r for r in rows if r[3] == uid]
        joined += [(flag, r) for r in mine] or [(flag, None)]
    joined += [(None, r) for r in rows if r[3] not in users]
    for rule in ("repaid", "good_behaviour"):
        pos, neg = Counter(), Counter()
        for flag, rep in joined:
            if rule == "repaid":
                pos[flag] += int(rep is not None and rep[1] is not None and rep[1] > 0)
            else:
                pos[flag] += int(flag is False)
            neg[flag] += int(flag is True)
        want = _table({k: (pos[k], neg[k]) for k in set(pos) | set(neg)})
        users_df = spark.createDataFrame([(u, "X", f) for u, f in users.items()], USERS)
        got = {r.bad_behavior: (r.positive, r.negative)
               for r in op.behaviour_payback(users_df, _reports_df(spark, rows), rule).collect()}
        assert got == want, rule
