"""SimHash near-duplicates by anchor points of a covering code.

The 64 bits are cut into parts.  Fingerprints that differ in few bits differ
in fewer still, at most ``threshold // parts``, in one of the parts.  A
part's anchors are the words of a covering code: a Hamming code on its lowest
bits, any value on the others; every value is at most one bit from exactly
one anchor, its home.  A fingerprint is replicated to every anchor within the
covering radius plus the part's threshold.  If two agree well enough in a
part, one of them so comes to the other's home; each anchor compares those at
home with all that came, on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_all_columns, id_key, materialize, text_hash
from .graph import components, forest

SEED = 42
BITS = 64
PARTS = 3
RADIUS = 1
#: Fingerprints at home that are compared in one task; an anchor that has more is dealt out in blocks.
HOME_BLOCK = 4096
#: So many anchors at most are sent to every executor as the list of those with several blocks.
BROADCAST_ANCHORS = 100_000
PAIRS_AT_ONCE = 1 << 18


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of the text's word shingles as a signed 64-bit integer; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)])
    ones = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(each, "doc_id long, text_hash long, fp long")


class Anchors:
    """The anchors of one part: bits ``low`` to ``low + width`` of a fingerprint."""

    def __init__(self, low: int, width: int, threshold: int):
        self.low, self.width = low, width
        check = (width + 1).bit_length() - 1
        self.coded = (1 << check) - 1
        # The syndrome is the XOR of the numbers, from 1, of the code's bits that are set.
        numbers = [i + 1 if i < self.coded else 0 for i in range(width)]
        masks = [sum(1 << i for i, x in enumerate(numbers) if x >> b & 1) for b in range(check)]
        self.masks = np.array(masks, dtype=np.uint64)
        self.flips = np.array([sum(1 << i for i in c) for k in range(RADIUS + threshold + 1) for c in combinations(range(width), k)], dtype=np.uint64)
        self.flip_syndromes = self.syndromes(self.flips)
        self.by_syndrome = [self.flips[self.flip_syndromes == s] for s in range(self.coded + 1)]
        self.correction = np.array([0] + [1 << i for i in range(self.coded)], dtype=np.uint64)

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        odd = np.bitwise_count(values[:, None] & self.masks[None, :]).astype(np.int64) & 1
        return odd @ (1 << np.arange(len(self.masks), dtype=np.int64))

    def of(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint number, anchor, whether it is home) for all anchors within the radius plus the threshold."""
        values = (fps >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)
        syndromes = self.syndromes(values)
        home = values ^ self.correction[syndromes]
        who, where = [], []
        for s in np.unique(syndromes):
            those = np.flatnonzero(syndromes == s)
            flips = self.by_syndrome[s]
            who.append(np.repeat(those, len(flips)))
            where.append((values[those, None] ^ flips[None, :]).ravel())
        who, where = np.concatenate(who), np.concatenate(where)
        return who, where, where == home[who]


def all_anchors(parts: int, threshold: int) -> list[Anchors]:
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [Anchors(a, b - a, threshold // parts) for a, b in zip(cuts, cuts[1:], strict=False)]


def replicas(distinct: DataFrame, parts: int, threshold: int) -> DataFrame:
    """(anchor, home, fp): each fingerprint at each of its anchors; the anchor's number holds its part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = all_anchors(parts, threshold)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, a in enumerate(anchors):
                for at in range(0, len(fps), 5_000):
                    some = fps[at:at + 5_000]
                    who, where, home = a.of(some)
                    yield pa.RecordBatch.from_arrays([
                        pa.array((where | np.uint64(part << 56)).view(np.int64)), pa.array(home), pa.array(some[who].view(np.int64))], names=["anchor", "home", "fp"])

    return distinct.select("fp").mapInArrow(each, "anchor long, home boolean, fp long")


def compare(threshold: int):
    """Sorted (anchor, block, at home first, fp) rows to links, of which those that join nothing new in the batch are left out.

    Only the fingerprints at home are carried from batch to batch.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([], dtype=np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, block = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            away, fps = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            anchor, block, fps = (np.concatenate(x) for x in zip(carried, (anchor, block, fps), strict=True))
            home = np.concatenate([np.ones(len(carried[0]), dtype=bool), ~away.astype(bool)])
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])]))
            size = np.diff(np.append(first, len(fps)))
            group = np.repeat(np.arange(len(first)), size)
            homes = np.flatnonzero(home & (size[group] > 1))
            counts = size[group[homes]]
            links = []
            at = 0
            ends = np.cumsum(counts)
            while at < len(homes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
                own, n = homes[at:to], counts[at:to]
                left = np.repeat(own, n)
                right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[own]], n)
                near = np.flatnonzero((np.bitwise_count(fps[left] ^ fps[right]) <= threshold) & (fps[left] != fps[right]))
                links += forest(zip(fps[left[near]].view(np.int64).tolist(), fps[right[near]].view(np.int64).tolist(), strict=True))
                at = to
            last = slice(first[-1], None)
            carried = [x[last][home[last]] for x in (anchor, block, fps)]
            found = forest(links)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])

    return each


def links(distinct: DataFrame, threshold: int, parts: int = PARTS) -> DataFrame:
    """(u, v): links between different fingerprints at most ``threshold`` bits apart, enough of them for the components."""
    posted = replicas(distinct, parts, threshold)
    crowded = posted.where("home").groupBy("anchor").agg(F.ceil(F.count("*") / HOME_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    crowded = materialize(crowded)
    few = crowded.count() <= BROADCAST_ANCHORS
    dealt = posted.join(F.broadcast(crowded) if few else crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # In each block but its own a fingerprint at home is one of those that came.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = dealt.withColumn("block", F.explode(every)).select("anchor", "block", (~(F.col("home") & (F.col("block") == own[0]))).alias("away"), "fp")
    together = dealt.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "away")
    return together.mapInArrow(compare(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row.

    Fingerprints at most ``threshold`` bits apart are linked; a row's
    component is the smallest id it reaches by links, its own included, and
    ``root`` its component's smallest fingerprint.
    Equal fingerprints are one node, whatever their number.  A null or empty
    text, and one of white space alone, has fingerprint 0, which links like
    any other; a null id is never the smallest (null if there is no other);
    repeated rows each have a result; an empty table gives no rows.  Other
    columns are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    smallest = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    found = components(links(smallest, threshold, parts))
    roots = smallest.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labels = roots.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_print = roots.join(labels, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, null last, then of the smallest text hash, then the first by all columns."""
    found = near_duplicates(docs, shingle, threshold, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    winners = first.select(id_key(F.col("first.doc_id")).alias("__id"), F.col("first.text_hash").alias("__hash"))
    rows = docs.withColumn("__id", id_key(F.col(id_col).cast("long"))).withColumn("__hash", text_hash(F.col(text_col)))
    same = Window.partitionBy("__id", "__hash").orderBy(*by_all_columns(docs))
    kept = rows.join(winners, ["__id", "__hash"]).withColumn("__n", F.row_number().over(same)).where(F.col("__n") == 1)
    return kept.select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
