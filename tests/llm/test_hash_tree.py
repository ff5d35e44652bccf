"""Hash tree: law, slots, movement."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from loanlag.llm import hash_tree
from loanlag.llm.hash_tree import Shard, layout
from tests.llm.helpers import EDGE, docs_of


def shards_of(spark, keys, shards):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.shard for r in df.select("k", hash_tree.descend(F.col("k"), shards).alias("shard")).collect()}


def test_edge_rows(spark):
    got = hash_tree.assign(docs_of(spark, EDGE), layout(24), layout(25)).collect()
    assert len(got) == len(EDGE)
    data = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in EDGE)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == data
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_empty(spark):
    assert hash_tree.assign(docs_of(spark, []), layout(24), layout(25)).count() == 0


def test_null_ids_are_counted_in_many_buckets(spark):
    docs = docs_of(spark, [(None, f"text {i}") for i in range(10_000)])
    rows = hash_tree.drawn(docs, layout(24), layout(25))
    assert rows.select("shard").distinct().count() == 1
    assert rows.groupBy("__bucket").count().agg(F.max("count")).first()[0] < 20
    assert sorted(r.slot for r in hash_tree.assign(docs, layout(24), layout(25)).collect()) == list(range(10_000))


def test_shares_follow_weights_and_growth_moves_only_into_the_new_shard(spark):
    keys = [str(i) for i in range(6000)]
    weighted = [Shard(0, "a", "a.0", 1.0), Shard(1, "a", "a.1", 2.0), Shard(2, "b", "b.0", 3.0)]
    n = Counter(shards_of(spark, keys, weighted).values())
    assert all(abs(n[s.number] - 1000 * s.weight) < 200 for s in weighted)
    for count in (24, 30):
        before, after = shards_of(spark, keys, layout(count)), shards_of(spark, keys, layout(count + 1))
        moved = {after[k] for k in keys if after[k] != before[k]}
        assert moved == {count}


def test_a_changed_weight_moves_nothing_between_other_subtrees(spark):
    keys = [str(i) for i in range(4000)]
    old = layout(24)
    new = [Shard(s.number, s.region, s.rack, 2.0 if s.number == 0 else 1.0) for s in old]
    before, after = shards_of(spark, keys, old), shards_of(spark, keys, new)
    region = {s.number: s.region for s in old}
    for k in keys:
        if region[before[k]] != "r0":
            assert after[k] == before[k] or region[after[k]] == "r0"
        else:
            assert region[after[k]] == "r0"
            if before[k] >= 4:  # the other rack of the region gets none of its documents elsewhere but by the rack that grew
                assert after[k] == before[k] or after[k] < 4
