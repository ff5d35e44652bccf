"""Binding of the driver's TPC-H style tables to the five loan tables.

The test data has no loan tables, so they are derived, deterministically,
from ``customer``, ``nation``, ``orders`` and ``lineitem`` (see FIXTURES.md).
The derivations deliberately plant nulls, orphans and duplicate rows so the
null rules and join fan-outs of the analysis are exercised.  The key-modulo
conditions below are those plants (every 17th customer's user has another id,
so that its loans have no user, every 7th one's report names no user, a null
flag for every 13th...): every source row is read and kept, and the tables
grow with the source tables.

Everything is a projection of one scan per source table; rows that appear
twice (a second listing or credit report) come from ``explode`` of a one- or
two-element array, not from a union that would scan the source again.
"""

from __future__ import annotations

import threading
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import LoanTables, conform

SECOND_COPY_OFFSET = 1_000_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def _copies(cond: Column) -> Column:
    """0 for every row, plus a second copy (1) where ``cond`` holds."""
    return F.explode(F.when(cond, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))


def _customers_with_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation has 25 rows by the TPC-H specification: a fixed-size broadcast.
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = _read(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)


# Nations bound to values of the preset groups, one to the string 'None'.
NATION_CODES = {"NATION_20": "US", "NATION_21": "DE", "NATION_22": "MX", "NATION_23": "None",
                "NATION_24": "United States"}


def _country(name: Column) -> Column:
    code = name
    for nation, value in NATION_CODES.items():
        code = F.when(name == nation, value).otherwise(code)
    return _null_if(name == "NATION_0", code)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = _customers_with_nation(spark, sf_dir), F.col("c_custkey")
    return conform(c.select(
        F.when(k % 17 == 0, -k - 1).otherwise(k).alias("id"),
        _country(F.col("n_name")).alias("country"),
        _null_if(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") < 0).alias("bad_behavior"),
    ), "users")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return conform(o.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        _null_if(F.col("o_orderkey") % 23 == 0, F.col("o_orderstatus") == "P").alias("reimbursed"),
    ), "loans")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", _copies(key % 41 == 0).alias("copy"))
    second = F.col("copy") == 1
    return conform(o.select(
        F.when(second, key + SECOND_COPY_OFFSET).otherwise(key).alias("id"),
        F.col("o_custkey").alias("user_id"),
        _null_if(key % 19 == 0, key).alias("loan_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") + 1).alias("payment_type_id"),
        F.when(~second & (key > 0) & (key % 10 == 0), key - 1).alias("parent_listing_id"),
    ), "listings")


def multi_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    due = F.to_date("l_shipdate")
    paid_shift = (F.col("l_partkey") % 41 - 25).cast("int")
    never_paid = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return conform(li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("loan_id"),
        due.alias("dtpayment"),
        _null_if(never_paid, F.date_add(due, paid_shift)).alias("dtpaid"),
        F.lit(7).alias("total_multi_payments"),
        F.col("l_linenumber").alias("multi_payment_number"),
    ), "multi_payments")


def credit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _customers_with_nation(spark, sf_dir)
    k = F.col("c_custkey")
    rows = base.select("*", _copies(k % 11 == 0).alias("copy"))

    def flag(n: int, m: int) -> Column:
        return _null_if(k % m == 0, k % n == 0)

    return conform(rows.select(
        F.when(F.col("copy") == 1, k + SECOND_COPY_OFFSET).otherwise(k).alias("id"),
        _null_if(k % 29 == 0, F.when(k % 7 == 0, -k - SECOND_COPY_OFFSET).otherwise(k)).alias("user_id"),
        _country(F.col("n_name")).alias("country"),
        F.col("c_mktsegment").alias("credit_label"),
        flag(2, 5).alias("has_credit_check"),
        flag(3, 7).alias("has_job"),
        (k % 37 == 0).alias("has_fake_email"),
        F.when(k % 3 == 0, "male").when(k % 3 == 1, "female").alias("gender"),
        flag(4, 9).alias("has_verified_phone"),
        flag(5, 8).alias("has_linkedin_login"),
        flag(6, 11).alias("has_otc"),
        flag(10, 13).alias("has_bitcointalk"),
        flag(3, 10).alias("has_verified_address"),
        flag(4, 15).alias("has_ebay"),
        flag(2, 9).alias("paypal_email_consistency"),
        (k % 3).alias("geo_demerit"),
        _null_if(k % 6 == 0, k % 50).alias("linkedin_connections"),
        (k % 24).alias("account_age"),
        flag(8, 21).alias("strongly_connected"),
        (k % 9).alias("pays_in_time"),
        _null_if(k % 13 == 0, F.col("c_acctbal") < 2000).alias("is_late"),
        _null_if(k % 31 == 0, k % 4).alias("repaid_loans"),
        (k % 3).alias("active_loans"),
    ), "credit_reports")


# Plans already built, per session and directory.  A DataFrame is an
# immutable plan, so every query over the same tables can share one; building
# (and analysing) the bindings again per query only costs driver time.
_BUILT: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_LOCK = threading.Lock()


def load_fixture(spark: SparkSession, sf_dir: str) -> LoanTables:
    """The five loan tables derived from the TPC-H tables in ``sf_dir``."""
    key = sf_dir.rstrip("/")
    with _LOCK:
        per_session = _BUILT.setdefault(spark, {})
        if key not in per_session:
            per_session[key] = LoanTables(
                multi_payments=multi_payments(spark, key),
                loans=loans(spark, key),
                users=users(spark, key),
                listings=listings(spark, key),
                credit_reports=credit_reports(spark, key),
            )
        return per_session[key]
