"""Suffix arrays and removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loanlag.llm import queries, suffix_dedup
from loanlag.llm.suffix_groups import suffix_array
from tests.conftest import SF0001
from tests.llm.helpers import EDGE, docs_of


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_long_runs_and_periods():
    for s in ([0] * 2000, [0, 1] * 1000, [1, 0] * 1000, list(range(2000)), list(range(2000))[::-1]):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    n = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, *_), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **more):
    """The digests, after a look at the text beside them."""
    return checked(suffix_dedup.digests(suffix_dedup.remove_repeats(df, **more)).collect())


def checked(rows):
    for r in rows:
        if "\ufffd" not in r.text:
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and len(r.text.encode()) == r.n_bytes - r.n_removed
    return sorted((tuple(r)[:5] for r in rows), key=str)


def repeats(seed=1):
    """Documents that share passages of lengths around the limit, at different places, with copies and near copies."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [text(n) for n in (260, 299, 300, 301, 450, 900)]
    rows = [(i, text(rng.randint(0, 400)) + rng.choice(shared)[rng.randint(0, 20):] + text(rng.randint(0, 300)) + rng.choice(shared)) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(9)]
    rows += [(200 + i, rows[5][1][:rng.randint(0, 900)] + "X" + rows[5][1][rng.randint(0, 900):]) for i in range(12)]
    rows += [(300, "ab" * 600), (301, "a" * 1000), (302, "ba" * 500 + shared[5] * 2)]
    return rows


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    assert checked(queries.op7_suffix_dedup(spark, SF0001).collect()) == brute(rows, 400)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_shared_passages(spark, group):
    rows = repeats()
    assert run(docs_of(spark, rows), length=300, group=group) == brute(rows, 300)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
@pytest.mark.parametrize("length, reach", [(172, 128), (250, 128), (250, 100)])
def test_shorter_reach(spark, length, reach, group):
    rows = repeats(2)
    assert run(docs_of(spark, rows), length=length, reach=reach, group=group) == brute(rows, length)


def test_edge_rows(spark):
    assert run(docs_of(spark, EDGE)) == brute(EDGE, 400)
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs_of(spark, EDGE), length=100)


def test_characters_stay_whole(spark):
    shared = "é" * 200  # 400 bytes, and again from the second byte of a character on
    rows = [(1, "è" + shared[1:] + "a" * 50 + "b" * 500), (2, "x" + shared + "y" + "c" * 300)]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), length=300, characters=True, carry=["lang"]).collect()
    for r in got:
        text = dict(rows)[r.doc_id]
        left = r.kept.decode()
        assert set(left) <= set(text) and r.carried.lang == "en"
