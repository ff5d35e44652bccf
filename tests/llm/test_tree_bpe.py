"""Segment-tree BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loanlag.llm import queries, tree_bpe
from tests.conftest import SF0001
from tests.llm.helpers import EDGE, docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tree_bpe.WordEncoder(PATH)


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(texts):
    assert ENCODER.documents(texts) == [want(t) for t in texts]


def test_words_of_every_length():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeé'") for _ in range(n)) for n in [*range(1, 70), 500, 3000]]
    assert ENCODER.documents(texts) == [want(t) for t in texts]


def test_given_documents_and_edge_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expect = lambda rows: sorted(((d, n, digest(i), digest(t)) for d, x, *_ in rows for n, i, t in [want(x)]), key=str)
    assert sorted((tuple(r) for r in queries.op6_tree_bpe(spark, SF0001).collect()), key=str) == expect(rows)
    got = tree_bpe.digests(tree_bpe.encode(docs_of(spark, EDGE), PATH)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expect(EDGE)
    assert tree_bpe.encode(docs_of(spark, []), PATH).count() == 0


def test_the_cache_starts_anew(monkeypatch):
    from loanlag.llm import chunk_cache

    monkeypatch.setattr(chunk_cache, "CACHE_PIECES", 5)
    encoder = tree_bpe.WordEncoder(PATH)
    texts = [f"some words number {i} {'long' * 40}" for i in range(30)]
    for t in texts:
        assert encoder.documents([t]) == [want(t)]
