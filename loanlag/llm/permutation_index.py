"""Approximate nearest neighbours over a permutation index.

A vector is represented by the order of its nearest pivots.  Each shard of
the index posts its vectors in one inverted file per pivot, with the pivot's
place in the vector's order.  A query walks the files of its own nearest
pivots, which adds up Spearman's footrule distance to every vector that
shares one; the nearest by footrule are reranked by cosine on the original
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_ids, distinct_vectors, each_length, matrix, padded_ids, result_table, sample_vectors, search_blocks, usable

#: Pivots are a sample of at most so many vectors.
N_PIVOTS = 256
#: Nearest pivots by which a vector is known.
PREFIX = 64
#: Share of a shard that a query reranks.
RERANK_SHARE = 0.15


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector the numbers of its ``prefix`` nearest pivots by cosine, nearest first, ties to the smaller number."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def with_orders(rows: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """Adds ``near``, the pivot order of ``vec``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                near = nearest_pivots(matrix(t["vec"]), pivots, prefix)
                flat = pa.array(near.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), flat)
                yield from t.append_column("near", lists).to_batches()

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(add, f"{schema}, near array<smallint>")


class Shard:
    """Inverted files of one shard: vector numbers and pivot places, by pivot."""

    def __init__(self, near: np.ndarray, n_pivots: int):
        self.n, self.prefix = near.shape
        order = np.argsort(near.ravel(), kind="stable")
        self.rows = (order // self.prefix).astype(np.int32)
        self.places = (order % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(near.ravel()[order], np.arange(n_pivots + 1))

    def closeness(self, near: np.ndarray) -> np.ndarray:
        """Half of (the greatest footrule distance minus the footrule distance) of each vector to a query.

        A pivot missing from an order stands at place ``prefix``; a shared
        pivot at places a and b then lowers the distance by
        2 * (prefix - max(a, b)).
        """
        total = np.zeros(self.n, dtype=np.int32)
        for place, pivot in enumerate(near):
            s = slice(self.starts[pivot], self.starts[pivot + 1])
            total[self.rows[s]] += self.prefix - np.maximum(self.places[s], place)
        return total


def search(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    n_pivots: int = N_PIVOTS, prefix: int = PREFIX, rerank_share: float = RERANK_SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine found for each query row.

    ``is_query`` is a condition on the column ``vec_id``.  A row is no
    candidate for queries of its own id; identical rows count once; ties go
    to the smaller id; with fewer than ``k`` candidates found, the query has
    fewer rows.  Equal vectors are indexed once with their ``k + 1``
    smallest ids, which is all a query can return of them.  Rows that
    ``vectors.usable`` leaves out (null, zero, non-finite) take no part.
    Vectors of different lengths are no candidates for each other.  An empty
    table gives no rows.  Every row is indexed; only the pivots are a sample.
    """
    rows = usable(vectors, id_col, vec_col, allow_zero=False)
    return each_length(rows, lambda some: search_equal(some, is_query, k, n_pivots, prefix, rerank_share))


def search_equal(rows: DataFrame, is_query, k: int, n_pivots: int, prefix: int, rerank_share: float) -> DataFrame:
    """``search`` over vectors of one length."""
    pivots = sample_vectors(rows, n_pivots)[1]
    prefix = max(1, min(prefix, len(pivots)))
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True) if len(pivots) else pivots
    reps = distinct_vectors(rows, k + 1)
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    counts = reps.count(), queries.count()

    def kernel(block: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if block.num_rows and asked.num_rows:
            # By smallest id, so that equal closeness is cut alike on every run.
            block = block.take(np.argsort(padded_ids(block["ids"], k + 1)[:, 0], kind="stable"))
            x, ids = matrix(block["vec"]), padded_ids(block["ids"], k + 1)
            shard = Shard(matrix(block["near"], np.int16), len(pivots))
            norms = np.linalg.norm(x, axis=1)
            n_rerank = min(len(x), max(40 * k, int(np.ceil(rerank_share * len(x)))))
            query_vecs = matrix(asked["vec"])
            for qid, q, near in zip(asked["query_id"].to_numpy(), query_vecs, matrix(asked["near"], np.int16), strict=True):
                close = shard.closeness(near)
                first = np.argsort(-close, kind="stable")[:n_rerank]
                scores = (x[first] @ q) / (norms[first] * np.linalg.norm(q))
                # All that can be among the best, ties and what rounding may hide included.
                need = min(k + 1, len(first))
                top = first[scores >= np.partition(scores, -need)[-need] - 1e-9]
                scores = (x[top] * q).sum(axis=1) / (norms[top] * np.linalg.norm(q))
                parts.append((qid, *best_ids(scores, ids[top], qid, k)))
        return result_table(parts, pa.float64())

    return search_blocks(with_orders(reps, pivots, prefix), with_orders(queries, pivots, prefix), *counts, k, "double", kernel)
