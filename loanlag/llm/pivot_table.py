"""Exact top-k inner products by pivot-table elimination.

The table holds every vector's distance to many pivots.  With the query's own
pivot distances each pivot gives a lower bound on the distance between query
and vector, |d(q, p) - d(x, p)|; the largest over the pivots turns into an
upper bound on the inner product, (|q|^2 + |x|^2 - bound^2) / 2.  Candidates
are evaluated in bound order until no remaining bound reaches the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_ids, distinct_vectors, each_length, matrix, padded_ids, result_table, sample_vectors, search_blocks, usable

N_PIVOTS = 32
#: Candidates evaluated at a time, in bound order.
CHUNK = 512


def quantized(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles, which hold these integers exactly."""
    out = np.floor(scale * vectors)
    if not np.isfinite(out).all():
        raise OverflowError("a component is too large to be scaled")
    return out


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; an error where one leaves a long.

    Doubles are used where they are exact, longs where no sum can leave them,
    and else Python's integers.
    """
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(query).sum())
    if largest < 2.0**53:
        return (rows @ query).astype(np.int64)
    if largest < 2.0**62 and max(np.abs(rows).max(initial=0), np.abs(query).max(initial=0)) < 2.0**62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    whole = [int(x) for x in query]
    products = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in rows]
    if any(not -(2**63) <= p < 2**63 for p in products):
        raise OverflowError("an inner product does not fit a long")
    return np.array(products, dtype=np.int64)


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots."""
    squares = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (rows @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def with_distances(rows: DataFrame, pivots: np.ndarray, scale: float) -> DataFrame:
    """``vec`` becomes its integers, ``far`` the distances to the pivots."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                x = quantized(matrix(t["vec"]), scale)
                far = pivot_distances(x, pivots)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield from t.set_column(t.column_names.index("vec"), "vec", lists(x)).append_column("far", lists(far)).to_batches()

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(add, f"{schema}, far array<double>")


def eliminate(x: np.ndarray, far: np.ndarray, q: np.ndarray, q_far: np.ndarray, need: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the evaluated rows, among them every row that can be among the ``need`` best.

    ``floor`` is a score that the ``need``-th best of all rows reaches.
    """
    lower = np.abs(far - q_far[None, :]).max(axis=1) if far.shape[1] else np.zeros(len(x))
    squares = (x**2).sum(axis=1)
    size = float(squares.max(initial=0) + (q**2).sum())
    # What rounding of the distances can add to a bound: a distance is off by less than 1e-6 of the largest.
    slack = 1.0 + 1e-6 * size
    upper = (squares + (q**2).sum() - lower**2) / 2 + slack
    order = np.argsort(-upper, kind="stable")
    seen, scores, best = [], [], np.array([], dtype=np.int64)
    for at in range(0, len(order), CHUNK):
        part = order[at:at + CHUNK]
        part = part[upper[part] >= floor]
        if not len(part):
            break
        got = exact_products(x[part], q)
        seen.append(part)
        scores.append(got)
        best = np.sort(np.concatenate([best, got]))[-need:]
        if len(best) == need:
            floor = max(floor, float(best[0]))
    if not seen:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    seen, scores = np.concatenate(seen), np.concatenate(scores)
    keep = scores >= floor
    return seen[keep], scores[keep]


def search(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: float = 256.0, n_pivots: int = N_PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` rows of highest inner product of floor(scale * x).

    ``is_query`` is a condition on the column ``vec_id``.  A row is no
    candidate for queries of its own id; identical rows count once; ties go
    to the smaller id; with fewer than ``k`` candidates all are returned.
    Rows whose vector is null, empty, or holds null or non-finite components
    take no part; zero vectors do.  Vectors of different lengths are no
    candidates for each other.  An empty table gives no rows.  The result is
    exact: the pivots are a bounded sample, but they only order and end the
    search.  A score that does not fit a long is an error.
    """
    rows = usable(vectors, id_col, vec_col, allow_zero=True)
    return each_length(rows, lambda some: search_equal(some, is_query, k, scale, n_pivots))


def search_equal(rows: DataFrame, is_query, k: int, scale: float, n_pivots: int) -> DataFrame:
    """``search`` over vectors of one length."""
    pivot_ids, pivots = sample_vectors(rows, n_pivots)
    pivots = quantized(pivots, scale)
    reps = distinct_vectors(rows, k + 1)
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    counts = reps.count(), queries.count()

    def kernel(block: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if block.num_rows and asked.num_rows:
            x, far, ids = matrix(block["vec"]), matrix(block["far"]), padded_ids(block["ids"], k + 1)
            for qid, q, q_far in zip(asked["query_id"].to_numpy(), matrix(asked["vec"]), matrix(asked["far"]), strict=True):
                known = np.sort(exact_products(pivots[pivot_ids != qid], q))[-k:]
                floor = float(known[0]) if len(known) == k else -np.inf
                rows_seen, scores = eliminate(x, far, q, q_far, k + 1, floor)
                parts.append((qid, *best_ids(scores, ids[rows_seen], qid, k)))
        return result_table(parts, pa.int64())

    return search_blocks(with_distances(reps, pivots, scale), with_distances(queries, pivots, scale), *counts, k, "long", kernel)
