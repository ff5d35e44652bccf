"""Phrase mining against counting in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loanlag.llm import phrase_mining
from loanlag.llm.count_automata import CountAutomaton, rows_of
from tests.llm.helpers import EDGE, docs_of

UPPER = {c: c + 32 for c in range(65, 91)}


def want(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] if len(r) > 2 else "en"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for m in range(1, min(longest, len(words) - i) + 1):
                    f[lang or "und"][tuple(words[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {p[i:k] for p, a in candidates.items() for i in range(len(p)) for k in range(i + 2, len(p) + 1) if k - i < len(p) and a >= counts[p[i:k]]}
        found = []
        for p, a in candidates.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if p not in covered:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(spark, rows, **kw):
    return sorted(map(tuple, phrase_mining.mine(docs_of(spark, rows), **kw).collect()))


def prose(rng, n, words):
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]
    return "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))


def test_edge_rows(spark):
    rows = [r if len(r[1] or "") < 1000 else (r[0], r[1][:5000], *r[2:]) for r in EDGE] + [(50, "A b a B a b ä\x01 a b", None), (51, "und und und und", "und"), (52, "a b\x0ba b\x0ca b", "x y")]
    assert got(spark, rows, least=2) == want(rows, 2)
    assert phrase_mining.mine(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize(("hot_state", "bucket_words"), [(2_000_000, 200_000), (3, 50)])
def test_random_prose(spark, monkeypatch, hot_state, bucket_words):
    """Small shards and blocks, hot states and hot parts, so that every union and every bucket is met."""
    rng = random.Random(13)
    words = "the of and Éa b\x02 to in x-y é日 10 foo bar baz qux".split(" ")
    rows = [(k, prose(rng, rng.choice([0, 3, 40, 400]), words), rng.choice(["en", "de", None, "und"])) for k in range(60)]
    if hot_state == 3:
        for name, value in (("SHARD_BYTES", 2000), ("UNITED_BYTES", 500), ("HOT_PART", 5), ("COMPOSED_AT_ONCE", 50)):
            monkeypatch.setattr(phrase_mining, name, value)
    assert got(spark, rows, least=4, hot_state=hot_state, bucket_words=bucket_words) == want(rows, 4)
    assert got(spark, rows, least=9, longest=3, top=7, hot_state=hot_state, bucket_words=bucket_words) == want(rows, 9, 3, 7)


def test_products_beyond_64_bits(spark):
    """The last steps on counts that no test text could reach."""
    a, n = 10**13, 10**16
    row = spark.createDataFrame([(a, n, 3 * 10**13, 7 * 10**13)], "a long, n long, l long, r long")
    up = "cast(1000 as decimal(4,0)) * (cast(a as decimal(19,0)) * cast(n as decimal(19,0)))"
    assert row.selectExpr(f"{up} div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) x").first()[0] == 1000 * a * n // (21 * 10**26)


def test_the_filter_lets_frequent_phrases_through(spark):
    phrases = [("en", f"w{k}", 5) for k in range(500)] + [("de", f"w{k} é{k}", 5) for k in range(500)]
    bits = phrase_mining.filter_bits(spark.createDataFrame(phrases, "lang string, phrase string, f long"))
    for lang, phrase, _ in phrases:
        first, *more = [phrase_mining.word_hashes([lang], [w.encode()]) for w in phrase.split(" ")]
        for h in more:
            first = first * phrase_mining.FOLD + h
        assert phrase_mining.bits_at(bits, first).all()
    assert np.unpackbits(bits).sum() <= 1000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é", "\x01"]), min_size=1, max_size=4), max_size=30), st.data())
def test_automaton(phrases, data):
    """Own weights, weights of prefixes and composition."""
    said = [" ".join(p) for p in phrases]
    count = Counter(said)
    asked = data.draw(st.lists(st.sampled_from([*said, "a a a a a", "b", "zz"]), max_size=10))
    rows, words = rows_of(pa.array(said + asked, pa.string()))
    automaton = CountAutomaton.united(rows[:len(said)], np.ones(len(said), dtype=np.int64))
    assert automaton.compose(rows[len(said):]).tolist() == [count[x] for x in asked]
    for length in range(1, automaton.rows.shape[1] + 1):
        begins = Counter(tuple(p[:length]) for p in phrases if len(p) >= length)
        states, weights = automaton.prefixes(length)
        assert {tuple(words[i].as_py() for i in s): w for s, w in zip(states.tolist(), weights.tolist(), strict=True)} == begins
        assert automaton.prefixes(length, 2)[1].tolist() == [w for w in weights.tolist() if w >= 2]
