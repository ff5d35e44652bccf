"""Readers for the five input tables: parquet/any file format, or JDBC.

Each reader returns a DataFrame conformed to ``schemas.SCHEMAS``: the contract
columns, in order, cast to their types.  Extra source columns are dropped in
the same ``select``, so Catalyst prunes them from the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS


@dataclass(frozen=True)
class LoanTables:
    """The five inputs of every analysis, already conformed."""

    multi_payments: DataFrame
    loans: DataFrame
    users: DataFrame
    listings: DataFrame
    credit_reports: DataFrame


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast ``df`` to the contract of ``table``.

    A missing column is an error: a silently added null column would turn
    every count built on it into a wrong answer.
    """
    schema = SCHEMAS[table]
    have = set(df.columns)
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, table: str, path: str, fmt: str = "parquet",
               options: dict[str, str] | None = None) -> DataFrame:
    """Read one table from files (parquet by default) and conform it.

    Columns are found by name in every format that has names; a missing one
    raises.  CSV with ``header=true`` is read by its header, which every file
    must repeat in the same order; without a header the columns are those of
    the contract, in order.  JSON names are gathered from all records first.
    A value that does not parse as its column's type raises (``FAILFAST``,
    unless the options name another mode).
    """
    options = dict(options or {})
    if fmt not in ("csv", "json"):
        return conform(spark.read.format(fmt).options(**options).load(path), table)
    names = {f.name: f for f in SCHEMAS[table].fields}
    schema = SCHEMAS[table]
    if fmt == "json":
        conform(spark.read.options(**options, primitivesAsString="true").json(path), table)
    elif str(options.get("header", "false")).lower() == "true":
        columns = spark.read.options(**options).csv(path).columns
        schema = T.StructType([names.get(c, T.StructField(c, T.StringType())) for c in columns])
        options.setdefault("enforceSchema", "false")
    options.setdefault("mode", "FAILFAST")
    return conform(spark.read.format(fmt).schema(schema).options(**options).load(path), table)


def read_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet",
                options: dict[str, str] | None = None) -> LoanTables:
    """Read all five tables from ``{table: path}`` with the same reader options."""
    return LoanTables(**{name: read_table(spark, name, paths[name], fmt, options)
                         for name in SCHEMAS})


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 partition_column: str | None = None, lower_bound: int | None = None,
                 upper_bound: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10_000, driver: str | None = None) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``.

    Credentials always come from the caller.  With a partition column the
    read is split into ``num_partitions`` range queries run in parallel tasks
    (one connection each) instead of a single task pulling the whole table.
    """
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver is not None:
        opts["driver"] = driver
    split = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise ValueError("partition_column, lower_bound, upper_bound and "
                             "num_partitions go together")
        if num_partitions < 1 or lower_bound >= upper_bound:
            raise ValueError("need num_partitions >= 1 and lower_bound < upper_bound")
        opts.update(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
        )
    return opts


def read_jdbc_table(spark: SparkSession, table: str, options: dict[str, str]) -> DataFrame:
    """Read one table over JDBC and conform it.

    Filters applied later (due date, payment types) are pushed into the
    database query by Catalyst, as are the pruned columns.
    """
    return conform(spark.read.format("jdbc").options(**options).load(), table)


def jdbc_bounds_query(table: str, column: str = "id") -> str:
    """SQL run by the database to find the split bounds: one row back."""
    return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"


def jdbc_quantile_query(table: str, num_partitions: int, column: str = "id") -> str:
    """SQL run by the database to find where each of ``num_partitions`` equally
    filled ranges begins: that many rows back, whatever the table's size."""
    return (f"SELECT MIN({column}) AS lo FROM (SELECT {column}, NTILE({int(num_partitions)}) OVER (ORDER BY {column}) AS part "
            f"FROM {table} WHERE {column} IS NOT NULL) ranked GROUP BY part ORDER BY lo")


def range_predicates(starts: list[int], column: str = "id") -> list[str]:
    """One WHERE clause a range; every row satisfies exactly one of them.

    The first range is open below and takes nulls, the last is open above, so
    rows that came after the starts were asked for are read too.
    """
    cuts = sorted(set(starts))[1:]
    if not cuts:
        return ["1 = 1"]
    between = [f"{column} >= {lo} AND {column} < {hi}" for lo, hi in zip(cuts, cuts[1:])]
    return [f"({column} < {cuts[0]} OR {column} IS NULL)", *between, f"{column} >= {cuts[-1]}"]


def read_jdbc_table_split(spark: SparkSession, table: str, url: str, num_partitions: int,
                          column: str = "id", user: str | None = None,
                          password: str | None = None, driver: str | None = None,
                          equal_width: bool = False) -> DataFrame:
    """Read one table over JDBC in ``num_partitions`` parallel range queries.

    The database gives the starts of equally filled ranges
    (``jdbc_quantile_query``), so a dense stretch of ids is split like any
    other.  ``equal_width`` asks for MIN and MAX only and cuts the ids evenly
    between them, for a database where ranking a table's ids costs too much.
    Nothing is lost if the table grows meanwhile.
    """
    access = {key: value for key, value in (("user", user), ("password", password), ("driver", driver)) if value is not None}
    ask = jdbc_bounds_query(table, column) if equal_width else jdbc_quantile_query(table, num_partitions, column)
    rows = spark.read.format("jdbc").options(url=url, query=ask, **access).load().collect()
    if not equal_width:
        starts = [int(row["lo"]) for row in rows]
        return conform(spark.read.jdbc(url, table, predicates=range_predicates(starts, column),
                                       properties={**access, "fetchsize": "10000"}), table)
    if not rows or rows[0]["lo"] is None:
        opts = jdbc_options(url, table, user, password, driver=driver)
    else:
        lo, hi = int(rows[0]["lo"]), int(rows[0]["hi"])
        opts = jdbc_options(url, table, user, password, partition_column=column,
                            lower_bound=lo, upper_bound=max(hi, lo + 1),
                            num_partitions=num_partitions, driver=driver)
    return read_jdbc_table(spark, table, opts)
