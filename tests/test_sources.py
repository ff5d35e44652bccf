import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loanlag import operators as op
from loanlag.functions import as_timestamp, period_bounds
from loanlag.session import checkpoint_dir, cluster_conf, shuffle_partitions_for
from loanlag.sources import SCHEMAS, conform, jdbc_options, read_table
from tests.conftest import SF001


def test_fixture_tables_follow_the_contracts(tables):
    for name, schema in SCHEMAS.items():
        df = getattr(tables, name)
        assert [(f.name, f.dataType) for f in df.schema.fields] == \
               [(f.name, f.dataType) for f in schema.fields], name


def test_fixture_row_counts(tables):
    counts = [getattr(tables, n).count()
              for n in ("users", "loans", "listings", "multi_payments", "credit_reports")]
    assert counts == [1500, 15000, 15366, 60000, 1637]


def test_conform_rejects_missing_columns(spark):
    df = spark.createDataFrame([(1, "US")], "id long, country string")
    with pytest.raises(ValueError, match="bad_behavior"):
        conform(df, "users")


def test_conform_casts_and_drops_extra_columns(spark):
    df = spark.createDataFrame([(1, "US", True, "x")], "id int, country string, bad_behavior boolean, extra string")
    out = conform(df, "users")
    assert out.columns == ["id", "country", "bad_behavior"]
    assert out.schema["id"].dataType.simpleString() == "bigint"


def test_read_csv_with_the_contract_schema(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="loanlag-csv-"), "users.csv")
    with open(path, "w") as fh:
        fh.write("id,country,bad_behavior\n1,US,true\n2,,false\n")
    df = read_table(spark, "users", path, fmt="csv", options={"header": "true"})
    assert sorted(tuple(r) for r in df.collect()) == [(1, "US", True), (2, None, False)]


def _file(name, text):
    path = os.path.join(tempfile.mkdtemp(prefix="loanlag-text-"), name)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_csv_columns_are_found_by_name(spark):
    path = _file("users.csv", "country,extra,id,bad_behavior\nUS,x,1,true\n,y,2,\n")
    df = read_table(spark, "users", path, fmt="csv", options={"header": "true"})
    assert sorted(tuple(r) for r in df.collect()) == [(1, "US", True), (2, None, None)]


def test_values_that_do_not_parse_raise(spark):
    header, cases = {"header": "true"}, [
        ("csv", "id,country,bad_behavior\nx2,US,true\n", {"header": "true"}),
        ("csv", "x2,US,true\n", {}),
        ("json", '{"id": "x2", "country": "US", "bad_behavior": true}\n', {}),
    ]
    assert header
    for fmt, text, options in cases:
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ|FAILFAST"):
            read_table(spark, "users", _file(f"users.{fmt}", text), fmt, options).collect()


def test_missing_fields_raise(spark):
    for fmt, text, options in (("csv", "id,country\n1,US\n", {"header": "true"}), ("json", '{"id": 1, "country": "US"}\n', {})):
        with pytest.raises(ValueError, match="bad_behavior"):
            read_table(spark, "users", _file(f"users.{fmt}", text), fmt, options)


def test_json_by_name(spark):
    path = _file("users.json", '{"country": "US", "id": 1}\n{"bad_behavior": false, "id": 2}\n')
    assert sorted(tuple(r) for r in read_table(spark, "users", path, "json").collect()) == [(1, "US", None), (2, None, False)]


def test_jdbc_options_partitioned_read():
    opts = jdbc_options("jdbc:postgresql://db/loans", "multi_payments", user="u", password="p",
                        partition_column="id", lower_bound=0, upper_bound=1_000_000,
                        num_partitions=64)
    assert opts["partitionColumn"] == "id" and opts["numPartitions"] == "64"
    assert opts["lowerBound"] == "0" and opts["upperBound"] == "1000000"
    assert opts["user"] == "u" and opts["dbtable"] == "multi_payments"


def test_jdbc_options_reject_partial_split():
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id", num_partitions=4)
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id", lower_bound=5, upper_bound=5,
                     num_partitions=4)


def test_parameter_validation(tables):
    with pytest.raises(ValueError):
        op.factor_payback(tables.credit_reports, "strongly_connections")
    with pytest.raises(ValueError):
        op.behaviour_payback(tables.users, tables.credit_reports, "whatever")
    with pytest.raises(ValueError):
        op.daily_counts(tables.multi_payments, "dtpaid")
    with pytest.raises(ValueError):
        op.loan_status_counts(tables.multi_payments, ["dtpaid"])
    with pytest.raises(ValueError):
        period_bounds(as_timestamp("2014-01-31").date(), 1)
    with pytest.raises(ValueError):
        as_timestamp("not a date")


def test_factor_names_are_case_insensitive(tables):
    assert op.factor_payback(tables.credit_reports, "COUNTRY").columns[0] == "country"


def test_cluster_sizing():
    assert shuffle_partitions_for(100 * 2**40, 8000) == 409600
    assert shuffle_partitions_for(1, 8) == 16
    conf = cluster_conf(10 * 2**40, 4000)
    assert conf["spark.sql.adaptive.enabled"] == "true"
    assert conf["spark.sql.autoBroadcastJoinThreshold"] == "-1"
    assert int(conf["spark.sql.adaptive.autoBroadcastJoinThreshold"]) > 0
    assert int(conf["spark.sql.shuffle.partitions"]) >= 8000


def test_checkpoint_dir_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_nothing_reads_outside_the_given_directory(spark):
    from loanlag.sources import load_fixture

    t = load_fixture(spark, SF001)
    for name in SCHEMAS:
        files = getattr(t, name).inputFiles()
        assert files and all("/sf0.01/" in f for f in files), name
    assert F is not None


def test_jdbc_bounds_query():
    from loanlag.sources import jdbc_bounds_query

    assert jdbc_bounds_query("loans") == "SELECT MIN(id) AS lo, MAX(id) AS hi FROM loans"


def test_jdbc_quantiles_split_dense_ids_evenly():
    """The database's side is plain SQL: run here by another engine."""
    import duckdb

    from loanlag.sources import jdbc_quantile_query, range_predicates

    con = duckdb.connect()
    con.execute("CREATE TABLE loans AS SELECT i AS id FROM range(9000) r(i) UNION ALL SELECT 1000000000 + i * 1000000 FROM range(1000) r(i) "
                "UNION ALL SELECT NULL FROM range(5)")
    starts = [r[0] for r in con.execute(jdbc_quantile_query("loans", 10)).fetchall()]
    clauses = range_predicates(starts)
    counts = [con.execute(f"SELECT count(*) FROM loans WHERE {c}").fetchone()[0] for c in clauses]
    assert len(clauses) == 10 and sum(counts) == 10_005 and max(counts) == 1005
    # Rows that came later, below and above all starts.
    con.execute("INSERT INTO loans VALUES (-5), (10000000000000)")
    assert sum(con.execute(f"SELECT count(*) FROM loans WHERE {c}").fetchone()[0] for c in clauses) == 10_007


def test_range_predicates_of_few_ids():
    from loanlag.sources import range_predicates

    assert range_predicates([]) == range_predicates([7]) == range_predicates([7, 7]) == ["1 = 1"]
    assert range_predicates([1, 4, 4, 9], "k") == ["(k < 4 OR k IS NULL)", "k >= 4 AND k < 9", "k >= 9"]


def test_jdbc_reads_by_quantiles(spark, monkeypatch):
    """What is asked of Spark's reader, with the database's answer put in."""
    from loanlag.sources import readers

    asked = {}

    class Reader:
        def format(self, kind):
            return self

        def options(self, **kw):
            asked.update(kw)
            return self

        def load(self):
            return spark.createDataFrame([(1,), (50,), (90,)], "lo long")

        def jdbc(self, url, table, predicates, properties):
            asked.update(url=url, table=table, predicates=predicates, properties=properties)
            return spark.createDataFrame([], readers.SCHEMAS["loans"])

    class Session:
        read = Reader()

    assert readers.read_jdbc_table_split(Session(), "loans", "jdbc:x", 3, user="u").columns == readers.SCHEMAS["loans"].names
    assert "NTILE(3)" in asked["query"] and asked["user"] == asked["properties"]["user"] == "u"
    assert asked["predicates"] == ["(id < 50 OR id IS NULL)", "id >= 50 AND id < 90", "id >= 90"]
