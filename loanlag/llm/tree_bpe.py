"""BPE encoding with a segment tree over the ranks of adjacent pairs.

A word's leaves are its adjacent pairs: a pair's merge rank and place, or
nothing where the pair has no merge.  Every inner node holds the smaller of
its children, so the root is the leftmost pair of the lowest rank.  A merge
changes three leaves and the path from each to the root; the word is done
when the root holds nothing.  Many words are worked on at once, one row of
the tree's matrix a word, which changes nothing in the order of a word's
merges.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunk_cache
from .chunk_cache import Lists, Numbers, runs

NOTHING = np.iinfo(np.int64).max
PLACE_BITS = 32
#: Leaves of the trees that are worked on at once.
LEAVES_AT_ONCE = 1 << 18

#: Printable letters of which normal form and lower case do not depend on their neighbours.
PLAIN = re.compile("[!-~¡-ſ]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, the others from U+0100 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + self.end] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NOTHING where there is no merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NOTHING)

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; an empty word has none."""
        out: list[np.ndarray] = [np.array([], dtype=np.int64)] * len(words)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        # A tree has a power of two leaves, one less than its longest word has bytes.
        leaves = np.where(lengths > 1, 1 << np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64), 1)
        for n in np.unique(leaves):
            of = np.flatnonzero((leaves == n) & (lengths > 0))
            step = max(1, LEAVES_AT_ONCE // int(n))
            for at in range(0, len(of), step):
                part = of[at:at + step]
                for k, ids in zip(part, self._merge([words[i] for i in part], lengths[part], int(n)), strict=True):
                    out[k] = ids
        return out

    def _merge(self, words: list[bytes], lengths: np.ndarray, leaves: int) -> list[np.ndarray]:
        count, width = len(words), leaves + 1
        # One symbol more than the longest word has stands for "after the end".
        symbols = np.full((count, width + 1), -1, dtype=np.int64)
        real = np.arange(width + 1) < lengths[:, None]
        symbols[real] = self.inner[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rows = np.arange(count)
        symbols[rows, lengths - 1] = self.last[[w[-1] for w in words]]
        tree = np.full((count, 2 * leaves), NOTHING, dtype=np.int64)
        pairs = np.arange(leaves) < (lengths - 1)[:, None]
        row, place = np.nonzero(pairs)
        tree[row, leaves + place] = self._leaf(symbols[row, place], symbols[row, place + 1], place)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        following = np.tile(np.arange(1, width + 2), (count, 1))
        before = np.tile(np.arange(-1, width), (count, 1))
        live = np.flatnonzero(tree[:, 1] != NOTHING)
        while len(live):
            root = tree[live, 1]
            at, rank = root & ((1 << PLACE_BITS) - 1), root >> PLACE_BITS
            gone = following[live, at]
            after, left = following[live, gone], before[live, at]
            symbols[live, at] = self.merged[rank]
            symbols[live, gone] = -1
            following[live, at] = after
            before[live, np.minimum(after, width)] = at
            new = symbols[live, at]
            more, has_left = after < lengths[live], left >= 0
            right_leaf = np.where(more, self._leaf(new, symbols[live, np.minimum(after, width)], at), NOTHING)
            left_at = np.maximum(left, 0)
            left_leaf = self._leaf(symbols[live, left_at], new, left_at)
            tree[live, leaves + at] = right_leaf
            inside = gone < leaves
            tree[live[inside], leaves + gone[inside]] = NOTHING
            tree[live[has_left], leaves + left[has_left]] = left_leaf[has_left]
            rows = np.concatenate([live, live[inside], live[has_left]])
            node = np.concatenate([at, gone[inside], left[has_left]]) + leaves
            while leaves > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                if node[0] == 1:
                    break
            live = live[tree[live, 1] != NOTHING]
        kept = symbols >= 0
        return np.split(symbols[kept], np.cumsum(kept.sum(axis=1))[:-1])

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.rank(left, right)
        return np.where(rank == NOTHING, NOTHING, (rank & ((1 << 30) - 1)) << PLACE_BITS | place)


class WordEncoder:
    """Pieces of text to ids and tokens, for a tokenizer file that normalizes, splits words and has no decoder.

    Normal form, lower case and the split into words are the library's for
    all but plain letters, where Python's are the same; the merges are done
    here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.library, self.merges = Tokenizer.from_file(path), Merges(path)
        self.split = regex.compile(described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.said_ids = pa.array([f"{i} " for i in range(size)], pa.large_binary())
        self.said_tokens = pa.array([(self.library.id_to_token(i) or "") + " " for i in range(size)], pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.pieces, self.words = Numbers(), Numbers()
        self.of_piece, self.of_word = Lists(), Lists()
        self.characters = 0

    def parts(self, piece: str) -> list[bytes | int]:
        """Words as bytes, and the ids of special tokens."""
        if PLAIN.fullmatch(piece) and not (self.at_special and "<" in piece):
            return [w.encode() for w in self.split.findall(piece.lower())]
        out: list[bytes | int] = []
        for x in self.at_special.split(piece) if self.at_special else [piece]:
            if x in self.special:
                out.append(self.special[x])
            elif x:
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(x))
                out += [bytes(self.bytes_of[c] for c in w) for w, _ in words]
        return out

    def learn(self) -> None:
        """Encodes the fresh pieces; of their words those that no piece before had."""
        pieces = self.pieces.taken()
        self.characters += sum(map(len, pieces))
        numbered = [[self.words[w] for w in self.parts(p)] for p in pieces]
        found = self.words.taken()
        merged = iter(self.merges.words([w for w in found if isinstance(w, bytes)]))
        each = [next(merged) if isinstance(w, bytes) else np.array([w]) for w in found]
        self.of_word.add(np.concatenate([np.array([], dtype=np.int64), *each]), np.array([len(x) for x in each], dtype=np.int64))
        ids, n = self.of_word.take(np.fromiter(chain.from_iterable(numbered), dtype=np.int64))
        ends = np.cumsum([len(x) for x in numbered], dtype=np.int64)
        self.of_piece.add(ids, np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0))

    def documents(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, the ids and the tokens (both joined by one blank) of each text.

        White space is in no word, so texts are cut at blanks and line ends.
        """
        codes = [list(map(self.pieces.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]
        self.learn()
        ids, n = self.of_piece.take(np.fromiter(chain.from_iterable(codes), dtype=np.int64))
        upto = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, codes)])]
        if len(self.pieces) > chunk_cache.CACHE_PIECES or self.characters > chunk_cache.CACHE_CHARACTERS:
            self.forget()
        return list(zip(np.diff(upto).tolist(), said(self.said_ids, ids, upto), said(self.said_tokens, ids, upto), strict=True))


def said(names: pa.Array, ids: np.ndarray, upto: np.ndarray) -> list[str]:
    """The names of the ids, each with a blank after it, in runs that end at ``upto``; without a run's last blank."""
    if not len(ids):
        return [""] * (len(upto) - 1)
    taken = names.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)[upto].tolist()
    data = taken.buffers()[2]
    return [data[begin:max(begin, end - 1)].to_pybytes().decode() for begin, end in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: the ids as text, joined by one blank, and their decoding.

    The ids are those of the tokenizers library without special tokens added;
    special tokens that stand in a text are found.  The decoding joins the
    ids' tokens by one blank, as the library does for a file without a
    decoder.  A null text counts as empty and has no ids; repeated rows each
    have a result; an empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for run in runs(texts):
                n, ids, decoded = zip(*encoder.documents(texts[run]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[run.start:run.stop], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(each, "doc_id long, n_tokens long, ids string, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
