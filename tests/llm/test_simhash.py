"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import xxhash

from loanlag.llm import queries, simhash_cover
from loanlag.llm.graph import components
from tests.conftest import SF0001
from tests.llm.helpers import EDGE, docs_of


def plain_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, threshold=4):
    """The smallest id of each row's component, by comparing all."""
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, *_), x in zip(rows, label):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return sorted(((d, f"{f:016x}", least.get(x)) for (d, *_), f, x in zip(rows, fps, label)), key=str)


def run(spark, df):
    from pyspark.sql import functions as F

    found = simhash_cover.near_duplicates(df)
    return sorted((tuple(r) for r in found.select("doc_id", simhash_cover.hex_digits(F.col("fp")), "component_id").collect()), key=str)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op5_simhash_cover(spark, SF0001).collect()), key=str)
    assert got == plain_components(rows)


def near_rows():
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 50, 160)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.integers(0, len(words), i % 4):
            words[k] = "other"
        rows.append((1000 - i, " ".join(words)))
    return rows


def test_edge_rows_and_chains(spark):
    rows = [*EDGE, *near_rows()]
    assert run(spark, docs_of(spark, rows)) == plain_components([(r[0], r[1]) for r in rows])


def test_crowded_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash_cover, "HOME_BLOCK", 3)
    rows = near_rows()
    assert run(spark, docs_of(spark, rows)) == plain_components(rows)
    monkeypatch.setattr(simhash_cover, "BROADCAST_ANCHORS", 0)
    assert run(spark, docs_of(spark, rows)) == plain_components(rows)


def test_empty(spark):
    assert simhash_cover.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash_cover.one_of_each(docs_of(spark, [])).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = [*EDGE, *near_rows()]
    found = simhash_cover.near_duplicates(docs_of(spark, rows)).collect()
    kept = simhash_cover.one_of_each(docs_of(spark, rows)).collect()
    root = {(r.doc_id, r.text_hash): r.root for r in found}
    assert len(kept) == len({r.root for r in found})
    smallest = {r.root: r.component_id for r in found}
    assert sorted((str(r.doc_id) for r in kept)) == sorted(str(x) for x in smallest.values())
    assert len(root) >= len(kept)


def test_every_close_pair_meets_at_a_home():
    rng = np.random.default_rng(2)
    for a in simhash_cover.all_anchors(3, 4) + simhash_cover.all_anchors(2, 4):
        x = rng.integers(0, 2**63, 40, dtype=np.uint64)
        flips = rng.integers(0, a.width, (40, (4 // 3) if a.width < 30 else 2))
        y = x.copy()
        for c in range(flips.shape[1]):
            y ^= np.uint64(1) << (flips[:, c].astype(np.uint64) + np.uint64(a.low))
        wx, ax, hx = a.of(x)
        wy, ay, _ = a.of(y)
        assert np.bincount(wx[hx], minlength=40).tolist() == [1] * 40
        visits = set(zip(wy.tolist(), ay.tolist()))
        assert all((w, z) in visits for w, z in zip(wx[hx].tolist(), ax[hx].tolist()))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_rows_of_equal_id_and_text_leave_the_same_one(spark):
    text = "one two three four five six"
    rows = [(1, text, "en", "b"), (1, text, "de", "a"), (1, text, None, "c"), (2, text, "en", "a")]
    kept = {tuple(simhash_cover.one_of_each(docs_of(spark, r).repartition(k)).select("doc_id", "lang", "source").first()) for r in (rows, rows[::-1]) for k in (1, 3)}
    assert kept == {(1, None, "c")}
