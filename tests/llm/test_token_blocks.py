"""Token blocks: exact round trips, and the files against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loanlag.llm import queries, token_blocks
from tests.conftest import SF0001
from tests.llm.helpers import EDGE, docs_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = token_blocks.LibraryEncoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, dtype=np.uint32)
    starts, data = token_blocks.pack(ids)
    assert token_blocks.unpack(data, starts)[:len(ids)].tolist() == values


def test_outliers_are_exceptions_and_documents_are_read_alone():
    ids = [np.arange(n, dtype=np.uint32) % 50 for n in (0, 5, 300, 1)]
    ids[2][7] = 4_000_000_000
    segment = token_blocks.Segment(token_blocks.write_segment([3, None, -1, 9], ids))
    assert segment.data[4 + int(segment.starts[0])] <= 6 and segment.data[5 + int(segment.starts[0])] == 1
    for n, x in enumerate(ids):
        assert segment.document(n).tolist() == x.tolist()
    assert segment.docs["null"].tolist() == [0, 1, 0, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab é'\n\t <|1", max_size=30)), max_size=5))
def test_encoding(texts):
    got = ENCODER.documents(texts)
    assert [x.tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["The", "élan", "×", "a÷b", "don't", "it.\nWho", "e\u0301t\u00e9", "ab", "", "x1", "<|endoftext|>", "\u1c89"]), max_size=6).map(" ".join), max_size=4),
       st.sampled_from(["", ",", "!!", "&&&", "'", "'s", "_", "\n", "¿"]))
def test_words_and_their_punctuation(texts, tail):
    texts = [t.replace(" ", tail + " ") + tail for t in texts]
    got = ENCODER.documents(pa.array(["left out", *texts], pa.string())[1:])
    assert [x.tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_blocks, "CACHE_PARTS", 3)
    texts = ["one two, three", "", "four  five two,", "one two, three"]
    for _ in range(2):
        got = ENCODER.documents(texts)
        assert [x.tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert not ENCODER.numbers


def test_batches_are_gathered_whole(monkeypatch):
    monkeypatch.setattr(token_blocks, "RUN_BYTES", 30)
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([n, None], pa.int64()), "text": pa.array(["x" * n, "y"])}) for n in range(9)]
    runs = list(token_blocks.gathered(iter(batches)))
    assert len(runs) > 1
    assert [k for keys, _ in runs for k in keys] == [k for n in range(9) for k in (n, None)]
    assert [t for _, texts in runs for t in texts.to_pylist()] == [t for n in range(9) for t in ("x" * n, "y")]


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for d, t, *_ in rows:
        ids = np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op10_token_blocks(spark, SF0001).collect()) == want(rows)


def test_edge_rows_and_small_segments(spark, monkeypatch):
    got = token_blocks.round_trip(docs_of(spark, EDGE).repartition(5), PATH).collect()
    one = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got}
    assert one == {(d, n, c) for d, _, n, c in want(EDGE)} and len(got) == len(EDGE)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == [sum(x.n_tokens for x in by_start[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in by_start]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_empty(spark):
    assert token_blocks.round_trip(docs_of(spark, []), PATH).count() == 0
