"""Token ids in files of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents.  Its ids are cut into
blocks of 128; a block stores its minimum and the differences to it, packed
at the width that a percentile of them needs.  Differences that need more
stand in the block's exception list.  An index gives each block's start, so
that a document is read without its neighbours.

Segment, little-endian::

    "PFR1" | documents u32 | ids u64 | blocks u32
    documents x (id is null u8, id i64, ids u32) | blocks x (start u32)
    blocks x (minimum u32, width u8, exceptions u8, 128 * width bits,
              exceptions x place u8, exceptions x difference u32)
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_cache import Lists, Numbers, runs_of
from .common import shared_folder, total_before

BLOCK = 128
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
#: Parts of texts that a Python worker keeps, and their characters, as some may be very long; beyond either the cache starts anew.
CACHE_PARTS = 1_000_000
CACHE_CHARACTERS = 32_000_000
#: Bytes of texts that are encoded at once, if there is more than one text.
RUN_BYTES = 4_000_000
#: Share of a block's differences that its width covers.
PERCENTILE = 0.9
#: A blank between two characters other than white space.
LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters, all of which are letters in any version of Unicode, and ASCII punctuation other than apostrophes.
PLAIN_PIECE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
MAGIC, HEAD, END_ID = b"PFR1", struct.Struct("<4sIQI"), 0
DOCUMENT = np.dtype([("null", "u1"), ("id", "<i8"), ("n", "<u4")])


def bits_needed(values: np.ndarray) -> np.ndarray:
    """Bits of each non-negative integer; 0 needs none."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and the blocks' bytes."""
    n_blocks = -(-len(ids) // BLOCK)
    full = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, dtype=np.uint32)
    full[:len(ids)] = ids
    blocks = full.reshape(n_blocks, BLOCK)
    low = blocks.min(axis=1, initial=2**32 - 1)
    delta = blocks - low[:, None]
    widths = bits_needed(np.partition(delta, int(PERCENTILE * BLOCK), axis=1)[:, int(PERCENTILE * BLOCK)])
    odd = bits_needed(delta) > widths[:, None]
    n_odd = odd.sum(axis=1)
    sizes = 6 + BLOCK // 8 * widths + 5 * n_odd
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4], out[starts + 5] = widths, n_odd
    for w in np.unique(widths[widths > 0]):
        of = np.flatnonzero(widths == w)
        kind = "<u1" if w <= 8 else "<u2" if w <= 16 else "<u4"
        values = np.where(odd[of], 0, delta[of]).astype(kind).view(np.uint8).reshape(len(of), BLOCK, -1)
        bits = np.unpackbits(values, axis=2, bitorder="little")[:, :, :w]
        out[starts[of, None] + 6 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(of), -1), axis=1, bitorder="little")
    block, place = np.nonzero(odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    lists = starts[block] + 6 + BLOCK // 8 * widths[block]
    out[lists + nth] = place
    at = lists + n_odd[block] + 4 * nth
    out[at[:, None] + np.arange(4)] = delta[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts, out


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts``, 128 a block."""
    starts = starts.astype(np.int64)
    low = data[starts[:, None] + np.arange(4)].reshape(-1).view("<u4")
    widths, n_odd = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    delta = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    for w in np.unique(widths[widths > 0]):
        of = np.flatnonzero(widths == w)
        packed = data[starts[of, None] + 6 + np.arange(BLOCK // 8 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(of), BLOCK, w)
        whole = np.zeros((len(of), BLOCK, 4), dtype=np.uint8)
        filled = np.packbits(bits, axis=2, bitorder="little")
        whole[:, :, :filled.shape[2]] = filled
        delta[of] = whole.view("<u4")[:, :, 0]
    block = np.repeat(np.arange(len(starts)), n_odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    lists = starts[block] + 6 + BLOCK // 8 * widths[block]
    at = lists + n_odd[block] + 4 * nth
    delta[block, data[lists + nth]] = data[at[:, None] + np.arange(4)].reshape(-1).view("<u4")
    return (delta + low[:, None]).reshape(-1)


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    docs = np.array([(d is None, d or 0, len(x)) for d, x in zip(doc_ids, ids, strict=True)], dtype=DOCUMENT)
    stream = np.concatenate(ids) if ids else np.array([], dtype=np.uint32)
    starts, blocks = pack(stream)
    head = HEAD.pack(MAGIC, len(docs), len(stream), len(starts))
    return b"".join([head, docs.tobytes(), starts.astype("<u4").tobytes(), blocks.tobytes()])


class Segment:
    """A segment's documents and, block by block, their ids."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token blocks")
        self.docs = np.frombuffer(data, DOCUMENT, n_docs, HEAD.size)
        at = HEAD.size + self.docs.nbytes
        self.starts = np.frombuffer(data, "<u4", n_blocks, at)
        self.data = np.frombuffer(data, np.uint8, offset=at + self.starts.nbytes)
        self.ends = np.cumsum(self.docs["n"].astype(np.int64))

    def all_ids(self) -> np.ndarray:
        return unpack(self.data, self.starts)[:self.n_ids]

    def document(self, n: int) -> np.ndarray:
        """The ids of the n-th document, from its blocks alone."""
        end = int(self.ends[n])
        begin = end - int(self.docs["n"][n])
        first, last = begin // BLOCK, -(-end // BLOCK)
        return unpack(self.data, self.starts[first:last])[begin - first * BLOCK:end - first * BLOCK]


class LibraryEncoder:
    """Texts to ids as the tokenizers library encodes them, each different part encoded once.

    A text is cut at its blanks.  Where a piece is empty or white space stands
    at its edge, the blanks were not alone; that text is cut again, at lone
    blanks only: between characters other than white space a tokenizer that
    splits before white space gives the same ids for the pieces, each with
    its blank, as for the whole.  The byte-level splitting rule also ends a
    word of letters at punctuation, so there a piece is two parts, the
    word with its blank and the punctuation; other pieces are one part.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.after_blank = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        rule = self.library.pre_tokenizer
        self.cuts = isinstance(rule, ByteLevel) and rule.use_regex and not rule.add_prefix_space and self.library.normalizer is None
        self.forget()

    def forget(self) -> None:
        self.numbers, self.lists, self.characters = Numbers(), Lists(), 0

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All parts' ids and how many each has."""
        found = []
        for at in range(0, len(parts), 20_000):
            found += [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(parts[at:at + 20_000], add_special_tokens=False)]
        return np.concatenate([np.array([], dtype="<u4"), *found]), np.array([len(x) for x in found], dtype=np.int64)

    def encode_joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts that begin with their only blank and have no white space at their edges otherwise.

        They are encoded as one text: a token that begins with a blank begins a part.
        """
        ids = np.array(self.library.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        begins = np.flatnonzero(self.after_blank[ids])
        return (ids, np.diff(np.append(begins, len(ids)))) if len(begins) == len(parts) else self.encode(parts)

    def learn(self) -> None:
        """Encodes the fresh parts."""
        fresh = self.numbers.taken()
        self.characters += sum(map(len, fresh))
        for at in range(0, len(fresh), 50_000):
            some = fresh[at:at + 50_000]
            joined = np.array([p != " " and p.count(" ") == 1 and " " + p.strip() == p for p in some])
            order = np.argsort(~joined, kind="stable")
            n = int(joined.sum())
            some = [some[i] for i in order.tolist()]
            (ids, sizes), (more, more_sizes) = self.encode_joined(some[:n]), self.encode(some[n:])
            batch = Lists()
            batch.add(np.concatenate([ids, more]), np.concatenate([sizes, more_sizes]))
            self.lists.add(*batch.take(np.argsort(order)))

    def parts(self, pieces: list[str], blank: str) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each piece, those of its parts (the second may be that of the empty one), and which pieces are empty or have white space at an edge."""
        number, plain = self.numbers.__getitem__, PLAIN_PIECE.fullmatch
        out, crowded, none = [], np.zeros(len(pieces), dtype=bool), number("")
        for at, p in enumerate(pieces):
            if self.cuts and (m := plain(p)):
                out.append(number(blank + m[1]))
                out.append(number(m[2]))
            else:
                out.append(number(blank + p))
                out.append(none)
                crowded[at] = not p or p.strip() != p
        return np.array(out, dtype=np.int64).reshape(-1, 2), crowded

    def documents(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        if not len(texts):
            return []
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = cut.flatten().dictionary_encode()
        pieces, piece = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        numbers, crowded = self.parts(pieces.tolist(), " ")
        which = numbers[piece]
        which[at[:-1]] = self.parts(pieces[piece[at[:-1]]].tolist(), "")[0]
        again = [k for k in np.unique(np.searchsorted(at[1:], np.flatnonzero(crowded[piece]), side="right")).tolist() if texts[k].as_py()]
        if again:
            rows = np.split(which, at[1:-1])
            for k in again:
                first, *others = LONE_BLANK.split(texts[k].as_py())
                rows[k] = np.concatenate([self.parts([first], "")[0], self.parts(others, " ")[0]])
            which = np.concatenate(rows)
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self.learn()
        ids, n = self.lists.take(which.ravel())
        ends = np.concatenate([[0], np.cumsum(n)])[2 * at[1:-1]]
        if len(self.numbers) > CACHE_PARTS or self.characters > CACHE_CHARACTERS:
            self.forget()
        return np.split(ids.astype("<u4"), ends)


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def library_ids(tokenizer_path: str) -> Callable[[pa.Array], list[np.ndarray]]:
    """Texts to arrays of ids, as the tokenizers library encodes the whole texts."""
    return lambda texts: worker_encoder(tokenizer_path).documents(texts)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Keys and texts of batches, of as many together as reach ``RUN_BYTES``."""
    keys: list[int | None] = []
    texts: list[pa.Array] = []
    for batch in batches:
        keys += batch.column(0).to_pylist()
        texts.append(batch.column(1))
        if sum(t.nbytes for t in texts) >= RUN_BYTES:
            yield keys, pa.concat_arrays(texts)
            keys, texts = [], []
    if keys:
        yield keys, pa.concat_arrays(texts)


def write(docs: DataFrame, path: str, encode: Callable[[pa.Array], list[np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents' ids as segments under ``path``, in ascending order of the ids (null first), then of a hash of the text.

    Each document's ids end with id 0; a null text counts as empty.  One row
    holds a segment: its part and number there, its counts and its bytes.
    Rows are ranged by Spark, and a task encodes and packs one range as a
    stream, so that it holds a segment at a time; a lost task is run again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()),
                "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([held], pa.int64()),
                "bytes": pa.array([write_segment(doc_ids, ids)], pa.binary()),
            })

        for keys, texts in gathered(batches):
            for run in runs_of(pc.binary_length(texts).to_pylist(), RUN_BYTES):
                for key, x in zip(keys[run], encode(texts[run]), strict=True):
                    doc_ids.append(key)
                    ids.append(np.append(x, np.uint32(END_ID)))
                    held += len(x) + 1
                    if held >= SEGMENT_IDS:
                        yield out()
                        doc_ids, ids, held, number = [], [], 0, number + 1
        if ids:
            yield out()

    ranged.mapInArrow(segments, "part int, segment int, n_docs long, n_ids long, bytes binary").write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the segments under ``path``."""
    files = spark.read.parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                segment = Segment(data)
                raw, ends, n = segment.all_ids().astype("<u4"), segment.ends, segment.docs["n"].astype(np.int64)
                crcs = [zlib.crc32(raw[e - k:e]) for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(n), pa.int32()), "segment": pa.array([number] * len(n), pa.int32()),
                    "doc_id": pa.array(segment.docs["id"], mask=segment.docs["null"].astype(bool)),
                    "offset": pa.array(ends - n), "n_tokens": pa.array(n), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    docs = files.select("part", "segment", "bytes").mapInArrow(
        documents, "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    base = total_before(files.select("part", "segment", "n_ids"), [], "part", ["segment"], "n_ids", "base").select("part", "segment", "base")
    return docs.join(base, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents into a new folder of the shared one and reads them back.

    Every row has a result, repeated rows and null ids too; an empty table
    gives no rows.  Other columns are not read.
    """
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, library_ids(tokenizer_path), id_col, text_col)
    return read(docs.sparkSession, path)
