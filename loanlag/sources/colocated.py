"""Payments, loans and listings stored by loan, so that repeated jobs shuffle none of them.

Bucketed tables keep their partitioning in the catalog: a join on the loan
reads matching buckets in one task.  Worth it where the same tables serve many
reports.  A bucket is read by one task, so a loan that holds more payments
than a task should read belongs to the unbucketed tables, whose shuffle AQE
can split.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from .readers import LoanTables

#: Table and the column that names the loan.
BY_LOAN = {"multi_payments": "loan_id", "loans": "id", "listings": "loan_id"}


def write_colocated(tables: LoanTables, buckets: int, path: str, prefix: str = "by_loan_") -> None:
    """Saves the three tables, bucketed by loan and sorted within buckets, as catalog tables ``<prefix><table>`` under ``path``.

    Rows are dealt to the buckets before the write: one file a bucket.  A
    listing without a loan is dealt out by its own id: as it meets no loan,
    any bucket will do.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    for name, column in BY_LOAN.items():
        rows: DataFrame = getattr(tables, name)
        (rows.repartition(buckets, column).write.format("parquet").mode("overwrite")
         .option("path", f"{path}/{name}").bucketBy(buckets, column).sortBy(column).saveAsTable(prefix + name))


def read_colocated(spark: SparkSession, tables: LoanTables, prefix: str = "by_loan_") -> LoanTables:
    """``tables`` with payments, loans and listings read from the bucketed tables."""
    return dataclasses.replace(tables, **{name: spark.table(prefix + name) for name in BY_LOAN})
