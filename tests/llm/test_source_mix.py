"""Source mix: targets, schedule, words taken."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loanlag.llm import source_mix
from tests.conftest import SF001
from tests.llm.helpers import EDGE, docs_of

WORD = re.compile(source_mix.WORD)


def waterfill(sizes, weights, repeats=3):
    """Targets by sharing the excess again and again."""
    target = dict.fromkeys(sizes, 0.0)
    capped = set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = sum(sizes.values()) - sum(repeats * sizes[s] for s in capped)
        target = {s: repeats * sizes[s] if s in capped else left * weights[s] / sum(weights[x] for x in free) for s in sizes}
        over = {s for s in free if target[s] > repeats * sizes[s]}
        if not over:
            return target
        capped |= over


def test_edge_rows(spark):
    got = source_mix.mix(docs_of(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    sizes = defaultdict(int)
    for r in EDGE:
        sizes[r[3] if len(r) > 3 else "s"] += len(WORD.findall(r[1] or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in EDGE)
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = waterfill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) < 1


def test_empty_and_wordless(spark):
    assert source_mix.mix(docs_of(spark, [])).count() == 0
    assert [(r["size"], r.target, r.taken) for r in source_mix.mix(docs_of(spark, [(1, None), (2, " ")])).collect()] == [(0, 0.0, 0)] * 2


def test_null_ids_are_shuffled_over_many_buckets(spark):
    docs = docs_of(spark, [(None, f"some text {i}") for i in range(10_000)])
    buckets = source_mix.sized(docs).groupBy(F.substring("shuffle", 1, 3)).count()
    assert buckets.agg(F.max("count")).first()[0] < 20
    got = source_mix.mix(docs).collect()
    assert len(got) == 10_000 and sum(r.taken for r in got) == 30_000


def test_schedule_follows_the_shares_all_along(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    per = source_mix.targets(source_mix.sized(docs)).cache()
    source_mix_rows = source_mix.schedule(per).orderBy("slot", "src", "rank").collect()
    need = {r.src: r.slots for r in per.collect()}
    given = Counter(r.src for r in source_mix_rows)
    assert given == {s: n for s, n in need.items() if n}
    words = Counter()
    for r in source_mix_rows:
        words[r.src] += r.words
    assert all(words[r.src] == r["take"] for r in per.collect())
    seen, total = Counter(), len(source_mix_rows)
    for n, r in enumerate(source_mix_rows, 1):
        seen[r.src] += 1
        if n < 0.9 * total:
            assert abs(seen[r.src] - n * need[r.src] / total) < 6
    for s in need:
        ranks = sorted(r["rank"] for r in source_mix_rows if r.src == s)
        assert ranks == list(range(need[s]))


def test_small_blocks_take_the_same_words(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"w{i} " * (i % 17), "en", f"s{i % 4}") for i in range(200)])
    whole = {r.doc_id: r.taken for r in source_mix.mix(docs).collect()}
    monkeypatch.setattr(source_mix, "BLOCK_WORDS", 7)
    assert {r.doc_id: r.taken for r in source_mix.mix(docs).collect()} == whole


def test_mixed_rows_hold_the_words_taken(spark):
    docs = docs_of(spark, [*EDGE, *[(100 + i, f"w{i}  x\n" * (i % 9), "en", f"s{i % 4}") for i in range(60)]])
    want = Counter()
    for r in source_mix.mix(docs).collect():
        want[r.doc_id] += r.taken
    out = source_mix.mixed(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == +want


def test_rows_of_equal_id_and_text_keep_their_sources(spark):
    """Words per source are those of the mix, whichever way the rows come in."""
    text = " ".join(f"w{i}" for i in range(13))
    rows = [(1, text, "en", "a"), (1, text, "en", "b"), (1, text, "de", "b"), (1, text, "en", None), (2, text + " x", "en", "b"), (None, text, "en", "a"), (None, text, "en", "a")]
    seen = set()
    for order in (rows, rows[::-1]):
        docs = docs_of(spark, order).repartition(3)
        wanted, got = {}, {}
        for r in source_mix.mix(docs).collect():
            wanted[r.source] = wanted.get(r.source, 0) + r.taken
        out = source_mix.mixed(docs).select("doc_id", "text", "lang", "source").collect()
        for r in out:
            got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert got == {k: v for k, v in wanted.items() if v}
        seen.add(tuple(sorted(map(str, out))))
    assert len(seen) == 1


def test_points_do_not_overflow(spark):
    ids = [0, 1, 2**31, 2**32 - 1, 2**32, 3_474_701_534, 2**40 + 12345]
    low, high = "id % 65536", "shiftright(id % 4294967296, 16)"
    got = spark.createDataFrame([(i,) for i in ids], "id long").selectExpr(f"(({high}) * {source_mix.STEP} % 4294967296 * 65536 + ({low}) * {source_mix.STEP}) % 4294967296 u").collect()
    assert [r.u for r in got] == [i * source_mix.STEP % 2**32 for i in ids]
