"""The pipeline's stages, each against plain Python on its own input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from loanlag.llm import source_mix
from loanlag.llm.common import materialize
from tests.conftest import SF001, SF0001
from tests.llm.helpers import EDGE, docs_of
from tests.llm.test_simhash import plain_components
from tests.llm.test_suffix import brute
from tests.llm.test_tree_bpe import want

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF0001}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF0001)))
    return [d.collect() for d in docs]


def test_languages(steps):
    before, after = steps[0], steps[1]
    ids = {r.doc_id for r in after}
    assert len(ids) >= 0.98 * len(before)
    assert {r.doc_id for r in before if any(c.isalpha() for c in r.text)} - ids == {r.doc_id for r in before} - ids
    assert [tuple(r) for r in after if r not in before] == []


def test_unlearned_scripts_and_noise_are_rejected(spark):
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang", "source").where("length(text) > 200")
    known = [tuple(r) for r in docs.orderBy("doc_id").limit(300).collect()]
    scripts = [(0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x9FA5), (0x61, 0x7B)]
    word = lambda script: "".join(chr(rng.randrange(*script)) for _ in range(rng.randint(2, 9)))
    foreign = [(10_000 + i, " ".join(word(scripts[i % 4]) for _ in range(200)), None) for i in range(200)]
    words = [w for _, t, *_ in known for w in re.findall(r"\b[a-z]{6,18}\b", t)]
    short = [(20_000 + i, w, None) for i, w in enumerate(rng.sample(words, 200))]
    short += [(30_000 + i, " ".join(rng.sample(words, 3) * 300), None) for i in range(20)]
    got = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs_of(spark, known + foreign + short), SF001).collect()}
    assert [d for d, *_ in foreign if d in got] == []
    assert [t for d, t, *_ in known + short if d not in got] == []
    assert all(r.lang is not None for r in got.values())


def test_one_of_each_group(steps):
    groups = plain_components([(r.doc_id, r.text) for r in steps[1]])
    assert {r.doc_id for r in steps[2]} == {c for _, _, c in groups}
    assert len(steps[2]) == len({c for _, _, c in groups})


def test_repeats_of_the_stage_length_are_gone(steps):
    lengths = {d: n - gone for d, n, gone, _, _ in brute([(r.doc_id, r.text) for r in steps[2]], corpus_pipeline.REPEAT_BYTES)}
    assert {r.doc_id for r in steps[3]} == set(lengths)
    for r in steps[3]:
        assert lengths[r.doc_id] <= len(r.text.encode()) <= lengths[r.doc_id] + 60 and r.n_chars == len(r.text)


def test_passages_of_51_words_are_removed(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n))
    passages = [words(51) for _ in range(20)]
    assert all(250 <= len(p) < 400 for p in passages)
    own = [[words(150), words(150)] for _ in range(40)]
    rows = [(i, f"{a}{i % 2} . {passages[i // 2]} . {i % 2}{b}") for i, (a, b) in enumerate(own)]
    got = {r.doc_id: r for r in corpus_pipeline.repeat_removal(spark, docs_of(spark, rows), SF0001).collect()}
    for i, (a, b) in enumerate(own):
        left = f"{a}{i % 2}{i % 2}{b}"
        assert got[i].text == left and got[i].n_chars == len(left)


def test_mix(steps):
    words = lambda t: len(re.findall(source_mix.WORD, t))
    sizes, got = defaultdict(int), defaultdict(int)
    for r in steps[3]:
        sizes[r.source] += words(r.text)
    for r in steps[4]:
        got[r.source] += words(r.text)
    whole = {r.doc_id: r.text for r in steps[3]}
    assert all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in steps[4])
    assert max(Counter(r.doc_id for r in steps[4]).values()) <= 4
    assert abs(sum(got.values()) - sum(sizes.values())) <= len(sizes)
    assert all(got[s] <= 3 * n for s, n in sizes.items())


def test_ids(steps):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expect = Counter((r.doc_id, n, digest(i), digest(d)) for r in steps[4] for n, i, d in [want(r.text)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in steps[5]) == expect
    assert all(len(r.ids) == r.n_tokens for r in steps[5])


def test_run_gives_the_last_stage(spark, steps):
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, corpus_pipeline.run(spark, SF0001).collect())) == sorted(map(key, steps[5]))


def test_edge_rows_pass_every_stage(spark):
    docs = docs_of(spark, EDGE)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF0001))
        assert name == "bpe" or docs.columns == COLUMNS
        assert docs.count() > 0
    empty = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF0001))
        assert empty.count() == 0
