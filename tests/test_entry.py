import __spark_entry__ as entry


def own_queries():
    """The queries of the reference's operators; the others have tests of their own."""
    return [(name, q) for name, q in entry.queries().items() if name in entry.QUERIES]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["day", "late_pct", "due_total", "late_total", "never_total"]
    assert df.count() > 0


def test_every_query_runs_at_sf0001(spark):
    from tests.conftest import SF0001

    for name, q in own_queries():
        df = q(spark, SF0001)
        assert df.count() >= 0, name


def test_every_column_is_named(spark):
    """The driver compares columns by name: no generated names like sum(x)."""
    import re

    from tests.conftest import SF0001

    for name, q in own_queries():
        cols = q(spark, SF0001).columns
        assert len(cols) == len(set(cols)), name
        assert all(re.fullmatch(r"[a-z_][a-z0-9_]*", c) for c in cols), (name, cols)
