"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that Spark hands to a Python worker at once: whole texts may be long.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where both are unset, a session that runs on this machine alone gets a
    temporary one; a cluster's executors would each write to a folder of
    their own, so there it is an error.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at storage that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: later jobs read the files, whichever executors are
    lost meanwhile.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    small_batches(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_hash(text: Column) -> Column:
    """A text's hash; with its id it names a row, as ids may be null or stand on several rows."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def id_key(id_: Column) -> Column:
    """An id as a key that is never null."""
    return F.coalesce(id_, F.lit(-(2**63)))


def by_all_columns(df: DataFrame) -> list[Column]:
    """An order that tells all different rows apart; a map column cannot be ordered, its text can."""
    return [F.col(c).cast("string") if "map<" in kind else F.col(c) for c, kind in df.dtypes]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition that lets null keys meet."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def total_before(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's earlier rows.

    Rows of a group are ordered by ``bucket``, then by ``order``.  The sums
    over whole buckets come first (one small row per group and bucket), then
    each bucket is added up by itself, so that no task holds a whole group.
    ``df`` is read twice; it must give the same rows both times.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = rows.join(base, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]), "left")
    return joined.select(*df.columns, (F.col("__base") + F.col("__own")).alias(out))
