"""Permutation index and pivot table against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlag.llm import permutation_index, pivot_table, queries
from tests.conftest import SF001

EVERY_50TH = "vec_id % 50 = 0"


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.select("*", *[F.lit(0).alias(c) for c in ("vec", "ids", "near", "far", "rb", "qb", "score", "rank", "query_id")])


def brute(rows, is_query, score, k=5):
    out = []
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    for q, a in distinct:
        if is_query(q):
            best = sorted((-score(a, b), i) for i, b in distinct if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def product(a, b):
    return int(np.floor(256 * np.array(a)).astype(int) @ np.floor(256 * np.array(b)).astype(int))


def given(spark):
    pdf = spark.read.parquet(f"{SF001}/embeddings.parquet").toPandas()
    return [(int(i), [float(x) for x in v]) for i, v in zip(pdf.vec_id, pdf.embedding)]


def test_permutation_index_recall_and_scores(spark):
    rows = given(spark)
    got = queries.op1_permutation_index(spark, SF001).collect()
    want = brute(rows, lambda i: i % 50 == 0, cosine)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, i) for q, _, i, _ in want if (q, i) in found]
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    by_id = dict(rows)
    for (q, i), s in found.items():
        assert s == pytest.approx(cosine(by_id[q], by_id[i]), abs=1e-12) and q != i


def test_pivot_table_is_exact(spark):
    got = sorted(tuple(r) for r in queries.op2_pivot_table(spark, SF001).collect())
    assert got == brute(given(spark), lambda i: i % 50 == 0, product)


def test_far_footrule_by_hand():
    shard = permutation_index.Shard(np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5]], dtype=np.int16), 6)
    near = np.array([0, 1, 2])
    full = 3 * 4
    places = lambda p: [list(p).index(x) if x in p else 3 for x in range(6)]
    for row, close in zip([[0, 1, 2], [2, 1, 0], [3, 4, 5]], shard.closeness(near)):
        assert full - 2 * close == sum(abs(a - b) for a, b in zip(places(row), places([0, 1, 2])))


@pytest.mark.parametrize("search,score", [(permutation_index.search, cosine), (pivot_table.search, product)])
def test_ties_copies_and_rows_that_take_no_part(spark, search, score):
    same = [1.0, 0.0, 0.5]
    good = [(i, same) for i in range(0, 130)] + [(200, [0.5, -0.25, 0.0]), (201, [0.5, -0.25, 0.0]), (200, [0.5, -0.25, 0.0])]
    bad = [(300, None), (None, same), (301, [1.0, None, 2.0]), (302, [float("nan"), 1.0, 1.0]), (303, [float("inf"), 1.0, 1.0]), (304, []), (350, [1.0, 2.0])]
    got = sorted(tuple(r) for r in search(table(spark, good + bad), EVERY_50TH).collect())
    want = brute(good, lambda i: i % 50 == 0, score)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_zero_vectors_count_for_products_alone(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])]
    assert permutation_index.search(table(spark, rows), EVERY_50TH).count() == 0
    got = sorted(tuple(r) for r in pivot_table.search(table(spark, rows), EVERY_50TH).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0)]


@pytest.mark.parametrize("search", [permutation_index.search, pivot_table.search])
def test_empty_and_single(spark, search):
    assert search(table(spark, []), EVERY_50TH).count() == 0
    assert search(table(spark, [(0, [1.0])]), EVERY_50TH).count() == 0


def test_elimination_keeps_every_row_that_can_win():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(-20, 20, (60, 4)).astype(float)
        q, pivots = rng.integers(-20, 20, 4).astype(float), x[:5]
        far, q_far = pivot_table.pivot_distances(x, pivots), pivot_table.pivot_distances(q[None], pivots)[0]
        seen, scores = pivot_table.eliminate(x, far, q, q_far, 6, -np.inf)
        best = np.sort(x @ q)[::-1][:6]
        assert list(np.sort(scores)[::-1][:6]) == list(best)
        assert set(np.flatnonzero(x @ q >= best[-1])) <= set(seen)


def test_several_blocks(spark, monkeypatch):
    from loanlag.llm import vectors

    monkeypatch.setattr(vectors, "ROWS_PER_BLOCK", 60)
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 3)
    got = sorted(tuple(r) for r in queries.op2_pivot_table(spark, SF001).collect())
    assert got == brute(given(spark), lambda i: i % 50 == 0, product)


def test_all_ties_are_compared_by_id(spark):
    """More equal cosines than any list of best rows holds."""
    rows = [(i, [float(2 ** (i % 7)), 0.0, 0.0]) for i in range(101)]
    got = permutation_index.search(table(spark, rows).repartition(5), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i, 1.0) for i in range(1, 6)]


@pytest.mark.parametrize("search,score", [(permutation_index.search, cosine), (pivot_table.search, product)])
def test_lengths_are_searched_apart(spark, search, score):
    two, three = [(i, [1.0 + i, 2.0]) for i in range(0, 60, 10)], [(i, [1.0, 2.0 - i, 0.5]) for i in range(5, 160, 5)]
    got = sorted(tuple(r) for r in search(table(spark, two + three), EVERY_50TH).collect())
    want = sorted(brute(two, lambda i: i % 50 == 0, score) + brute(three, lambda i: i % 50 == 0, score))
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_products_are_exact_beyond_doubles(spark):
    big = 2.0**22
    rows = [(0, [big, big + 0.25, 1.0]), (1, [big, big, 3.0]), (2, [big + 1, big - 1, 2.0]), (3, [-big, 2.0**23, 0.0])]
    exact = lambda a, b: sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))
    got = sorted(tuple(r) for r in pivot_table.search(table(spark, rows), EVERY_50TH).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, exact)
    assert pivot_table.exact_products(np.array([[2.0**40, -(2.0**40)]]), np.array([2.0**30, 2.0**30 - 1])).tolist() == [2**40]
    for fails in (lambda: pivot_table.exact_products(np.array([[2.0**40]]), np.array([2.0**30])), lambda: pivot_table.quantized(np.array([1e308]), 256.0)):
        with pytest.raises(OverflowError):
            fails()
