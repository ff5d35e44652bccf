"""Token alignment against each text's tokens compared one by one."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from loanlag.llm import queries, token_alignment
from tests.conftest import SF0001
from tests.llm.helpers import EDGE, docs_of

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALIGNER = token_alignment.Aligner(*PATHS)
BYTES = ALIGNER.a.bytes.to_pylist(), ALIGNER.b.bytes.to_pylist()
ODD = [
    None, "", " ", "  ", "a  b\n\nc  d", " x ", "▁x y", "a<|endoftext|>b <s> </s> <unk>", "x" * 3000, "é̂ ﬁ Å", "\x1c a \x1c", "a\x85 b", "   lead", "trail   ",
    "日" * 200 + " " * 50 + "x" * 700, "a b   c", "👩‍👩‍👧 ok", "12345 " * 40 + " ▁▁ a", "﻿x", "a ▁ b", "<0x41>", "x\x00y",
]


def whole(text):
    """Groups of the whole text's tokens, encoded in one."""
    if not text:
        return []
    ids = ALIGNER.a.encode([text])[0], ALIGNER.b.encode([text])[0]
    tokens = [[of[i] for i in x] for of, x in zip(BYTES, ids, strict=True)]
    if any(b"".join(t) != b" " + text.encode() for t in tokens):
        return []
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in tokens]
    groups = []
    for end in sorted(set(ends[0]) & set(ends[1])):
        begin = groups[-1][2] if groups else 0
        groups.append(([i for i, e in zip(ids[0], ends[0], strict=True) if begin < e <= end], [i for i, e in zip(ids[1], ends[1], strict=True) if begin < e <= end], end))
    return groups


def said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)


def links(groups):
    return Counter((x, y) for a, b, _ in groups for x in a for y in b)


def check(texts):
    size = len(BYTES[1])
    for text, row in zip(texts, ALIGNER.align(texts).to_pylist(), strict=True):
        groups, linked = whole(text), links(whole(text))
        assert row["groups"] == said(groups), text
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()))
        assert {(p // size, p % size): n for p, n in zip(row["pairs"], row["pair_links"], strict=True)} == linked


def want(rows):
    found = [(r[0], whole(r[1])) for r in rows]
    documents, best = Counter(), defaultdict(int)
    for _, groups in found:
        documents.update(links(groups).keys())
    for (a, _), n in documents.items():
        best[a] = max(best[a], n)
    out = []
    for key, groups in found:
        linked = links(groups)
        out.append((
            key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()),
            sum(n for p, n in linked.items() if documents[p] == best[p[0]]), sum(n * documents[p] for p, n in linked.items()),
            hashlib.sha256(said(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_odd_texts():
    check(ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab AB\n.é日▁\t '1<"), max_size=30), max_size=4))
def test_any_text(texts):
    check(texts)


def test_large_groups_count_the_same(monkeypatch):
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 1)
    check([*ODD, "tokenization of unusualwordshere and thereof"])


def test_the_overlaps_are_all_overlaps():
    start = [np.array(x) for x in ([0, 2, 5, 6, 9], [0, 1, 5, 7, 8])]
    end = [np.append(s[1:], 12) for s in start]
    doc = np.zeros(5, dtype=np.int64)
    pairs = set(zip(*[x.tolist() for x in token_alignment.overlaps(doc, start[0], doc, start[1])], strict=True))
    assert pairs == {(i, k) for i in range(5) for k in range(5) if start[0][i] < end[1][k] and start[1][k] < end[0][i]}


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_token_alignment(spark, SF0001).collect()), key=str) == want(rows)


def test_edge_rows_with_and_without_frequent_pairs(spark):
    rows = [r[:2] if len(r[1] or "") < 1000 else (r[0], r[1][:3000]) for r in EDGE] + list(enumerate(ODD, 50))
    expect = want(rows)
    assert sorted((tuple(r) for r in token_alignment.digests(docs_of(spark, rows), *PATHS).collect()), key=str) == expect
    aligned = token_alignment.materialize(token_alignment.align(docs_of(spark, rows), *PATHS))
    for bound in (1, 20, 10**9):
        counted = token_alignment.with_corpus_counts(aligned, len(BYTES[1]), bound).select("doc_id", "n_best", "count_sum").collect()
        assert sorted(map(tuple, counted), key=str) == sorted(((r[0], r[5], r[6]) for r in expect), key=str)
    assert token_alignment.digests(docs_of(spark, []), *PATHS).count() == 0


def test_the_cache_starts_anew(spark, monkeypatch):
    aligner = token_alignment.Aligner(*PATHS)
    for k in range(5):
        aligner.forget()
        assert aligner.align([f"some text {k}", ODD[4]])["groups"].to_pylist() == [said(whole(f"some text {k}")), said(whole(ODD[4]))]
