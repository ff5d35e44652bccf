"""Vector tables: which rows take part, equal vectors, blocks of queries against blocks of rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct vectors and queries that meet in one task.
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048


def usable(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """(vec_id long, vec array<double>): the rows that take part, identical rows once.

    Left out: null ids and vectors, vectors that hold null or non-finite
    components, empty ones, and all-zero ones unless ``allow_zero``.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0)).where(~bad)
    if not allow_zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    return rows.distinct()


def each_length(rows: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over the vectors of each length by themselves: between lengths there is no measure."""
    lengths = sorted(r["n"] for r in rows.select(F.size("vec").alias("n")).distinct().collect()) or [0]
    found = [search(rows.where(F.size("vec") == n)) for n in lengths]
    return reduce(DataFrame.unionByName, found)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): each vector once with its ``keep`` smallest ids.

    A group of equal vectors never comes together: each task passes on its
    ``keep`` smallest ids at most.
    """
    smallest = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("__n", F.row_number().over(smallest)).where(F.col("__n") <= keep)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def sample_vectors(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``n`` different vectors, the same ones on every run."""
    got = (
        rows.groupBy("vec").agg(F.min("vec_id").alias("vec_id"))
        .orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()
    )
    dim = len(got[0]["vec"]) if got else 0
    return (np.array([r["vec_id"] for r in got], dtype=np.int64),
            np.array([r["vec"] for r in got], dtype=np.float64).reshape(len(got), dim))


def matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)


def padded_ids(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of at most ``width`` ids as a matrix; places without an id hold the smallest long."""
    out = np.full((len(column), width), np.iinfo(np.int64).min, dtype=np.int64)
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    off = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at, off] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def best_ids(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (score, id) of some vectors, without the id ``own``; ties to the smaller id."""
    flat, score = ids.ravel(), np.repeat(scores, ids.shape[1])
    real = (flat != np.iinfo(np.int64).min) & (flat != own)
    flat, score = flat[real], score[real]
    order = np.lexsort((flat, -score))[:k]
    return score[order], flat[order]


def search_blocks(
    reps: DataFrame, queries: DataFrame, n_reps: int, n_queries: int, k: int, score_type: str,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
) -> DataFrame:
    """Every query block against every block of vectors; the best ``k`` of all blocks for each query.

    Blocks are dealt by a hash, and a pair of blocks is one group, so a task
    holds a bounded number of vectors.  ``kernel`` gets both blocks and
    returns (query_id, vec_id, score), at most ``k`` rows a query.
    """
    rb, qb = max(1, math.ceil(n_reps / ROWS_PER_BLOCK)), max(1, math.ceil(n_queries / QUERIES_PER_BLOCK))
    left = (
        reps.withColumn("rb", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(rb)))
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))))
    )
    right = (
        queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)))
        .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rb - 1).cast("long"))))
    )
    found = (
        left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb"))
        .applyInArrow(kernel, f"query_id long, vec_id long, score {score_type}")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def result_table(parts: list[tuple[int, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Table:
    """(query_id, vec_id, score) of a kernel."""
    sizes = [len(ids) for _, _, ids in parts]
    return pa.table({
        "query_id": pa.array(np.repeat(np.array([q for q, _, _ in parts], dtype=np.int64), sizes)),
        "vec_id": pa.array(np.concatenate([i for _, _, i in parts]) if parts else np.array([], dtype=np.int64), pa.int64()),
        "score": pa.array(np.concatenate([s for _, s, _ in parts]) if parts else np.array([]), kind),
    })
