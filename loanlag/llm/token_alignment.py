"""Which tokens of two tokenizers cover the same bytes.

For each token start of one side ``merge_asof``, keyed by document, finds the
token of the other side that covers it.  Both directions together are all
overlaps; overlaps whose tokens end at the same byte cut a document into
groups.  Tokens of one group are linked.  How many documents link a pair of
ids is counted over the whole corpus and given back to every document.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_cache import Numbers, runs
from .common import materialize
from .token_blocks import LONE_BLANK
from .tree_bpe import byte_symbols

#: Pieces that a Python worker keeps; beyond it the cache starts anew.
CACHE_PIECES = 400_000
#: Fresh pieces that are encoded at once.
ENCODED_AT_ONCE = 20_000
#: Groups of more links than this are counted by distinct ids and their multiples.
LARGE_GROUP = 1 << 12
#: Pairs that hold more than this share of all rows (document, pair) are sent to every task; so they are fewer than its inverse.
FREQUENT_PAIRS = 500_000
#: The blank of a sentence piece.
PIECE_BLANK = "▁"


class Side:
    """One tokenizer: pieces to ids, and each id's bytes.

    ``piece`` stands after a blank, which belongs to it.
    """

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = pa.array(token_bytes, pa.large_binary())
        self.length = np.array([len(b) for b in token_bytes], dtype=np.int64)
        self.blank = np.array([b.startswith(b" ") for b in token_bytes])
        self.forget()

    def forget(self) -> None:
        self.flat = np.array([], dtype=np.int32)
        self.starts, self.sizes = np.array([], dtype=np.int64), np.array([], dtype=np.int64)

    def learn(self, pieces: list[str], plain: np.ndarray) -> np.ndarray:
        """Takes up the pieces; whether each one's bytes are a blank and its own.

        Plain pieces hold no white space and nothing that one side takes for
        a blank.  They are encoded as one text: a token that begins with a
        blank begins a piece.
        """
        starts, sizes, right = (np.empty(len(pieces), dtype=t) for t in (np.int64, np.int64, bool))
        for which in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            some = [pieces[i] for i in which.tolist()]
            if not some:
                continue
            ids = np.array(self.encode([" ".join(some)])[0], dtype=np.int32) if plain[which[0]] else np.array([], dtype=np.int32)
            begins = np.flatnonzero(self.blank[ids])
            if len(begins) != len(some):
                each = [np.array(x, dtype=np.int32) for x in self.encode(some)]
                ids, n = np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
                begins = np.cumsum(n) - n
            starts[which], sizes[which] = begins + len(self.flat), np.diff(np.append(begins, len(ids)))
            self.flat = np.concatenate([self.flat, ids])
            joined = self.joined(ids)
            ends = np.append(np.concatenate([[0], np.cumsum(self.length[ids])])[begins], len(joined))
            right[which] = [joined[s:e] == b" " + p.encode() for s, e, p in zip(ends[:-1].tolist(), ends[1:].tolist(), some, strict=True)]
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        return right

    def joined(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, one after the other."""
        taken = self.bytes.take(pa.array(ids))
        return taken.buffers()[2].to_pybytes()[:int(self.length[ids].sum())] if len(ids) and taken.buffers()[2] else b""

    def ids_of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered pieces, and how many each has."""
        n = self.sizes[pieces]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[pieces] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


class ByteLevel(Side):
    """A byte-level tokenizer of the tokenizers library; a blank is put before the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        super().__init__([bytes(byte_of[c] for c in t) for t in tokens])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class SentencePiece(Side):
    """A sentencepiece model, which puts the blank before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: No piece goes on after a blank, so merges stay between lone blanks.
        self.splits_at_blanks = not any(re.search(f"[^{PIECE_BLANK}]{PIECE_BLANK}", p) for p in pieces)
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(PIECE_BLANK, " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Aligns the tokens of two tokenizers, text by text.

    Texts are cut at lone blanks, between characters other than white space,
    where neither tokenizer merges; each different piece is encoded once.
    """

    def __init__(self, byte_level_path: str, piece_path: str):
        self.a, self.b = ByteLevel(byte_level_path), SentencePiece(piece_path)
        self.cut_at_blanks = self.b.splits_at_blanks
        # An id's text with what follows it: in a group, at the end of side A, at the end of the group.
        size = max(len(self.a.length), len(self.b.length))
        self.said = pa.array([f"{i}{end}" for i in range(size) for end in ",|;"], pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.numbers, self.right, self.crowded = Numbers(), np.array([], dtype=bool), np.array([], dtype=bool)
        self.a.forget()
        self.b.forget()

    def learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        for at in range(0, len(fresh), ENCODED_AT_ONCE):
            some = fresh[at:at + ENCODED_AT_ONCE]
            crowded = np.array([not p or p[0].isspace() or p[-1].isspace() for p in some])
            plain = ~crowded & np.array([len(p.split(None, 1)) == 1 and PIECE_BLANK not in p for p in some])
            self.right = np.concatenate([self.right, self.a.learn(some, plain) & self.b.learn(some, plain)])
            self.crowded = np.concatenate([self.crowded, crowded])

    def pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbered pieces of all texts, and how many each text has; a text whose bytes are not given back has none."""
        number = lambda parts: list(map(self.numbers.__getitem__, parts))
        codes = [number(t.split(" ") if self.cut_at_blanks else [t]) if t else [] for t in texts]
        self.learn()
        flat, of = self.flat(codes)
        again = np.unique(of[self.crowded[flat]]).tolist() if self.cut_at_blanks else []
        for k in again:
            codes[k] = number(LONE_BLANK.split(texts[k]))
        self.learn()
        flat, of = self.flat(codes)
        for k in np.unique(of[~self.right[flat]]).tolist():
            ids = [side.ids_of(np.array(codes[k]))[0] for side in (self.a, self.b)]
            if any(side.joined(x) != b" " + texts[k].encode() for side, x in zip((self.a, self.b), ids, strict=True)):
                codes[k] = []
        flat, _ = self.flat(codes)
        return flat, np.array([len(c) for c in codes], dtype=np.int64)

    @staticmethod
    def flat(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = [len(c) for c in codes]
        return np.fromiter(chain.from_iterable(codes), dtype=np.int64, count=sum(n)), np.repeat(np.arange(len(codes)), n)

    def align(self, texts: list[str | None]) -> pa.RecordBatch:
        """Counts, groups and links of each text."""
        pieces, per_text = self.pieces(texts)
        text_of = np.repeat(np.arange(len(texts)), per_text)
        (ids_a, n_a), (ids_b, n_b) = self.a.ids_of(pieces), self.b.ids_of(pieces)
        doc_a, doc_b = np.repeat(text_of, n_a), np.repeat(text_of, n_b)
        ends_a, ends_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b])
        over_a, over_b = overlaps(doc_a, ends_a - self.a.length[ids_a], doc_b, ends_b - self.b.length[ids_b])
        equal = ends_a[over_a] == ends_b[over_b]
        last_a, last_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
        last_a[over_a[equal]] = last_b[over_b[equal]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        count = lambda docs, weights=None: np.bincount(docs, weights, len(texts)).astype(np.int64)
        links = np.concatenate([[0], np.cumsum(in_a * in_b)])
        groups_of = count(doc_a[last_a])
        upto = np.concatenate([[0], np.cumsum(groups_of)])
        said = self.say(ids_a, group_a, last_a, ids_b, group_b, last_b, count(doc_a), count(doc_b))
        codes, times, codes_of = self.links(len(texts), ids_a, group_a, ids_b, group_b, in_a, in_b, doc_a[last_a])
        offsets = pa.array(np.concatenate([[0], np.cumsum(codes_of)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(count(doc_a)), pa.array(count(doc_b)), pa.array(groups_of), pa.array(np.diff(links[upto])), said,
             pa.ListArray.from_arrays(offsets, pa.array(codes)), pa.ListArray.from_arrays(offsets, pa.array(times))],
            names=["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"])

    def links(self, n_texts: int, ids_a, group_a, ids_b, group_b, in_a, in_b, doc_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's linked pairs of ids (as one number), in order, and their links; how many pairs each text has."""
        first_b = np.cumsum(in_b) - in_b
        large = in_a * in_b > LARGE_GROUP
        small = np.flatnonzero(~large[group_a])
        n = in_b[group_a[small]]
        ends = np.cumsum(n)
        at_b = np.repeat(first_b[group_a[small]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        keys = [doc_of[group_b[at_b]] * PAIR_SPAN + np.repeat(ids_a[small], n).astype(np.int64) * len(self.b.length) + ids_b[at_b]]
        times = [np.ones(len(at_b), dtype=np.int64)]
        first_a = np.cumsum(in_a) - in_a
        for g in np.flatnonzero(large).tolist():
            a, times_a = np.unique(ids_a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
            b, times_b = np.unique(ids_b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
            keys.append((doc_of[g] * PAIR_SPAN + a.astype(np.int64)[:, None] * len(self.b.length) + b).ravel())
            times.append((times_a[:, None] * times_b).ravel())
        key, weight = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], dtype=np.int64)
        pairs = key[begins]
        return pairs % PAIR_SPAN, np.add.reduceat(weight, begins) if len(begins) else weight, np.bincount(pairs // PAIR_SPAN, minlength=n_texts)

    def say(self, ids_a, group_a, last_a, ids_b, group_b, last_b, of_a, of_b) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3``: the ids of each text's groups."""
        n_a, n_b = len(ids_a), len(ids_b)
        if not n_a:
            return pa.array([""] * len(of_a), pa.string())
        # Side A of a group stands before its side B.
        place_a = np.arange(n_a) + np.searchsorted(group_b, group_a, side="left")
        place_b = np.arange(n_b) + np.searchsorted(group_a, group_b, side="right")
        word = np.empty(n_a + n_b, dtype=np.int64)
        word[place_a], word[place_b] = ids_a.astype(np.int64) * 3 + last_a, ids_b.astype(np.int64) * 3 + 2 * last_b
        taken = self.said.take(pa.array(word))
        at = np.frombuffer(taken.buffers()[1], np.int64, n_a + n_b + 1)[np.concatenate([[0], np.cumsum(of_a + of_b)])]
        data = taken.buffers()[2]
        # The last group's end is no part of the text.
        return pa.array([data[s:max(s, e - 1)].to_pybytes().decode() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())


#: More than any pair's number: ids of both sides are below 2^16 here; checked when a worker starts.
PAIR_SPAN = 1 << 32


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that overlap, for starts in ascending order: the union of both directions of ``merge_asof``."""
    a = pd.DataFrame({"start": start_a, "doc": doc_a, "place": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "doc": doc_b, "place": np.arange(len(start_b))})
    covering_b = pd.merge_asof(a, b, on="start", by="doc", suffixes=("", "_other"))["place_other"].to_numpy(dtype=np.int64)
    covering_a = pd.merge_asof(b, a, on="start", by="doc", suffixes=("", "_other"))["place_other"].to_numpy(dtype=np.int64)
    return np.concatenate([a["place"].to_numpy(), covering_a]), np.concatenate([covering_b, b["place"].to_numpy()])


@lru_cache(maxsize=1)
def worker_aligner(byte_level_path: str, piece_path: str) -> Aligner:
    aligner = Aligner(byte_level_path, piece_path)
    if len(aligner.a.length) * len(aligner.b.length) > PAIR_SPAN:
        raise ValueError("the vocabularies have too many pairs")
    return aligner


def align(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, pair_links) of every row.

    Side A is a byte-level tokenizer on a blank and the text, side B a
    sentencepiece model on the text.  ``groups`` holds the ids, written
    ``a1,a2|b1;a3|b2,b3``; ``pairs`` the different linked pairs of ids, each
    as A's id times B's vocabulary size plus B's id; ``pair_links`` how often
    each is linked.  ``row`` numbers the rows.  A text that is null or empty,
    or that either side's tokens do not give back byte by byte, has no
    tokens: zeros, '' and empty lists.  Repeated rows each have a result; an
    empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = worker_aligner(byte_level_path, piece_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for run in runs([t or "" for t in texts]):
                found = aligner.align(texts[run])
                if len(aligner.numbers) > CACHE_PIECES:
                    aligner.forget()
                n = run.stop - run.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0)[run.start:run.stop], *found.columns], names=["row", "doc_id", *found.schema.names])
                row += n

    return rows.mapInArrow(
        each, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, pair_links array<long>")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, documents, best) of every linked pair: the documents that link it, and whether no other pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    # One id has no more partners than the other side's vocabulary has ids.
    highest = F.max("documents").over(Window.partitionBy(F.expr(f"pair div {b_size}")))
    return counts.select("pair", "documents", (F.col("documents") == highest).alias("best"))


def with_corpus_counts(aligned: DataFrame, b_size: int, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to ``align``'s rows, in place of their lists; ``aligned`` is read three times and must give the same rows.

    Every row is a document.  Pairs that hold more than the
    ``frequent_pairs``-th part of all rows (document, pair) are fewer than
    that by arithmetic; they are broadcast.  The rest are shuffled; no pair
    among them is hot.
    """
    counts = materialize(pair_counts(aligned, b_size))
    total = counts.agg(F.sum("documents")).first()[0] or 0
    is_frequent = F.col("documents") * F.lit(frequent_pairs) > F.lit(total)
    frequent, others = counts.where(is_frequent), counts.where(~is_frequent)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("links"))
    met = each.join(F.broadcast(frequent), "pair", "left")
    known = met.where(F.col("documents").isNotNull()).select("row", "links", "documents", "best")
    rare = met.where(F.col("documents").isNull()).select("row", "pair", "links").join(others, "pair").select("row", "links", "documents", "best")
    sums = known.unionByName(rare).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum"))
    joined = aligned.drop("pairs", "pair_links").join(sums, "row", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def digests(docs: DataFrame, byte_level_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of all documents."""
    from sentencepiece import SentencePieceProcessor

    hashed = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    aligned = materialize(align(docs, byte_level_path, piece_path).withColumn("groups_sha256", hashed).drop("groups"))
    counted = with_corpus_counts(aligned, SentencePieceProcessor(model_file=piece_path).get_piece_size())
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
