"""Removal of repeated substrings by suffix arrays.

Every string of ``length`` bytes, a window, belongs to an anchor: the leftmost
place of the smallest hash among its first ``reach`` places.  That depends on
the window's bytes alone, so equal windows have equal anchors at the same
place.  The windows of one document that share an anchor make a strip.  Only
strips whose anchors begin with the same bytes can hold equal windows; Spark
brings those together.  Equal strips are one class; a class of several strips
is repeated as a whole.  What different strips share is found by suffix
arrays (``suffix_groups``), one over what follows the anchors and one over
what precedes them, read backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, null_safe
from .suffix_groups import suffix_array

#: Places of a window that can be its anchor, where none are given.
REACH = 256
#: Bytes that a window has beyond its reach, at least.
BEYOND = 44
#: Bytes that the hash of a place looks at.
GRAM = 16
#: Bytes that are one symbol of the suffix arrays.
SYMBOL = 64
#: Classes of one anchor that are sorted in one task; more are first split by longer common strings.
GROUP = 4096
#: Classes sorted at once, if their groups are small.
AT_ONCE = 2048
#: A group too large is split by so many ranges of window starts at a time.
FAN = 4
#: Bytes hashed at once.
BUFFER = 500_000

STRIP = "doc_id long, text_hash long, anchor int, lo int, hi int, key long, strip long"


def place_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; ``data`` ends with GRAM bytes more."""
    x = data.astype(np.uint64)
    for bits in (8, 16, 32):
        step = bits // 8
        x = x[:-step] | x[step:] << np.uint64(bits)
    h = x[:-8] * np.uint64(0x9E3779B97F4A7C15) + (x[8:] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h[:len(data) - GRAM]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n - width + 1], up[width - 1:n])


def strips_of(texts: list[bytes], length: int, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first and last window start, key, hash of the strip) of all texts' strips."""
    joined = b"".join(texts)
    data = np.frombuffer(joined + bytes(reach + GRAM), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    bits = np.uint64(max(len(data), 2).bit_length())
    places = np.arange(len(data) - GRAM, dtype=np.uint64)
    least = sliding_least(place_hashes(data) >> bits << bits | places, reach) & ((np.uint64(1) << bits) - np.uint64(1))
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[text]
    anchor = least[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(start) else np.array([], dtype=np.int64)
    last = np.append(first[1:], len(start))[:len(first)] - 1
    lo, hi, anchor, text = start[first], start[last], anchor[first], text[first]
    common = length - reach + 1
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(joined)
    keys = np.array([digest(view[a:a + common]) for a in anchor.tolist()], dtype=np.uint64)
    strips = np.array([digest(view[a:b + length], (q - a) << 16 | b - a) for a, b, q in zip(lo.tolist(), hi.tolist(), anchor.tolist(), strict=True)], dtype=np.uint64)
    at = begins[text]
    return text, anchor - at, lo - at, hi - at, keys.view(np.int64), strips.view(np.int64)


def strips(docs: DataFrame, length: int, reach: int = REACH) -> DataFrame:
    """All strips of (doc_id, text_hash, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                end, held = at + 1, len(texts[at])
                while end < len(texts) and held + len(texts[end]) <= BUFFER:
                    held += len(texts[end])
                    end += 1
                text, anchor, lo, hi, key, strip = strips_of(texts[at:end], length, reach)
                own = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), *[pa.array(x.astype(np.int32)) for x in (anchor, lo, hi)], pa.array(key), pa.array(strip)],
                    names=["doc_id", "text_hash", "anchor", "lo", "hi", "key", "strip"])
                at = end

    return docs.mapInArrow(each, STRIP)


def order(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings' order, and how many bytes each shares with the one before it.

    The suffix array is that of all strings, cut into symbols of SYMBOL bytes
    and one after another; only the suffixes at which a string begins are
    used.
    """
    blocks = [[s[i:i + SYMBOL] for i in range(0, len(s), SYMBOL)] for s in strings]
    numbers = {b: i + 1 for i, b in enumerate(sorted({b for x in blocks for b in x}))}
    symbols: list[int] = []
    begin = {}
    for k, x in enumerate(blocks):
        begin[len(symbols)] = k
        symbols += [numbers[b] for b in x]
        symbols.append(0)
    sorted_ = np.array([begin[i] for i in suffix_array(symbols) if i in begin], dtype=np.int64)
    grid = np.zeros((len(strings), width), dtype=np.uint8)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    grid[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(strings), dtype=np.uint8)
    grid, sizes = grid[sorted_], sizes[sorted_]
    differ = grid[1:] != grid[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))
    return sorted_, np.concatenate([[0], shared])[:len(strings)]


def repeated_windows(before: list[bytes], after: list[bytes], least: np.ndarray, most: np.ndarray, count: np.ndarray, length: int, reach: int = REACH) -> list[list[tuple[int, int]]]:
    """For each class the runs of windows that occur elsewhere too, as (from, to) distances before the anchor.

    ``before`` holds what precedes the anchor, ``after`` what it and its
    followers are; a class has the windows that begin ``least`` to ``most``
    bytes before its anchor, and ``count`` strips.  Two windows that begin l
    bytes before their anchors are equal if the anchors' followers share
    length - l bytes and the l bytes before them are the same: neighbours in
    the two sorted orders tell which strings share so much.
    """
    n = len(after)
    right, right_shared = order(after, length)
    left, left_shared = order([b[::-1] for b in before], reach)
    found = np.zeros((n, int(most.max()) + 1), dtype=bool)
    for l in range(int(least.min()), int(most.max()) + 1):
        own = (least <= l) & (l <= most)
        right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        right_class[right] = np.cumsum(right_shared < length - l)
        left_class[left] = np.cumsum(left_shared < l)
        both = (right_class * (n + 1) + left_class)[own]
        _, which = np.unique(both, return_inverse=True)
        found[own, l] = np.bincount(which, weights=count[own])[which] > 1
    runs = []
    for row in found:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], row, [False]]).astype(np.int8)))
        runs.append([(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return runs


def sort_groups(members: DataFrame, length: int, reach: int = REACH) -> DataFrame:
    """(key, strip, runs) of classes: groups of one ``part`` are kept together, several small ones are sorted at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            runs = repeated_windows([r[5] for r in rows], [r[6] for r in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.array([r[7] for r in rows]), length, reach)
            some = [(r, x) for r, x in zip(rows, runs, strict=True) if x]
            pairs = [[{"first": a, "last": b} for a, b in x] for _, x in some]
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r, _ in some], pa.int64()), pa.array([r[2] for r, _ in some], pa.int64()), pa.array(pairs, RUNS)], names=["key", "strip", "runs"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[0] != held[-1][0] and len(held) >= AT_ONCE:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    columns = ["part", "key", "strip", "least", "most", "before", "after", "n"]
    together = members.select(*columns).repartition("part").sortWithinPartitions("part", "key", "strip")
    return together.mapInArrow(each, "key long, strip long, runs array<struct<first:int,last:int>>")


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def split_groups(members: DataFrame, length: int, reach: int) -> DataFrame:
    """The classes of groups too large, each once for every range of ``reach`` window starts.

    All windows of a range share the bytes from the range's last start to its
    first window's end.  That longer string is the new ``part``, so the group
    falls apart; what is left of a class is hashed anew as ``rest``.
    """
    ranges = F.sequence(F.floor(F.col("least") / reach).cast("int"), F.floor(F.col("most") / reach).cast("int"))
    rows = members.withColumn("range", F.explode(ranges))
    low, high = F.col("range") * reach, F.col("range") * reach + reach - 1
    rows = rows.withColumn("least", F.greatest("least", low)).withColumn("most", F.least("most", high))
    before = F.substring(F.col("before"), F.length("before") - F.least(high, F.length("before")) + 1, F.least(high, F.length("before")))
    rows = rows.withColumn("low", low).withColumn("high", high).withColumn("before", before)
    rows = rows.withColumn("after", F.substring(F.col("after"), F.lit(1), F.lit(length) - F.col("low")))
    # What all windows of the range hold, whichever of them the class has.
    core = F.concat(
        F.substring(F.col("before"), F.length("before") - F.col("low") + 1, F.col("low")),
        F.substring(F.col("after"), F.lit(1), F.lit(length) - F.col("high")))
    part = F.xxhash64("part", "range", F.lit(reach), core)
    rest = F.xxhash64(part, "least", "most", "before", "after")
    return rows.withColumn("rest", rest).withColumn("part", part).drop("range", "low", "high")


def shared_runs(members: DataFrame, length: int, group: int = GROUP, reach: int = REACH) -> DataFrame:
    """(key, strip, runs) of the classes in ``members`` that share windows with others.

    ``members``: part, key, strip, least, most, before, after, n.  Groups of
    at most ``group`` classes are sorted; larger ones are split by longer
    common strings until they are small enough.  A range of one window start
    needs no sorting: its part is the window.
    """
    found, starts = None, reach
    while True:
        sizes = materialize(members.groupBy("part").agg(F.count("*").alias("classes")).where("classes > 1"))
        sized = members.join(sizes, "part")
        small = sort_groups(sized.where(F.col("classes") <= group), length, reach)
        found = small if found is None else found.unionByName(small)
        if sizes.where(F.col("classes") > group).isEmpty():
            return found
        starts = max(starts // FAN, 1)
        split = materialize(split_groups(sized.where(F.col("classes") > group), length, starts))
        # Equal rests are repeated as they are; one of them stays to be compared with the others of its part.
        rests = materialize(split.groupBy("part", "rest").agg(F.sum("n").alias("all"), F.min(F.struct("key", "strip")).alias("kept")))
        joined = split.join(rests, ["part", "rest"])
        whole = joined.where("all > 1").select("key", "strip", F.array(F.struct(F.col("least").alias("first"), F.col("most").alias("last"))).alias("runs"))
        found = found.unionByName(whole)
        if starts <= 1:
            return found
        one_each = joined.where((F.col("kept.key") == F.col("key")) & (F.col("kept.strip") == F.col("strip")))
        members = materialize(one_each.select("part", "key", "strip", "least", "most", "before", "after", F.col("all").alias("n")))


def repeated_spans(docs: DataFrame, length: int, group: int = GROUP, reach: int = REACH) -> DataFrame:
    """(doc_id, text_hash, spans): the byte ranges of the windows of (doc_id, text_hash, text) that occur more than once."""
    all_strips = materialize(strips(docs, length, reach))
    # Written, so that the join below stands between two plain shuffles, of which Spark splits the large partitions.
    several = materialize(all_strips.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    live = materialize(all_strips.join(several, "key"))
    first = F.min(F.struct("doc_id", "text_hash", "anchor", "lo", "hi")).alias("at")
    classes = materialize(live.groupBy("key", "strip").agg(F.count("*").alias("n"), first))
    mixed = materialize(classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1").select("key"))
    wanted = classes.join(mixed, "key").select("key", "strip", "n", "at.*")
    per_text = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "strip", "n", "anchor", "lo", "hi")).alias("wanted"))
    bytes_of = docs.withColumn("bytes", F.col("text").cast("binary")).drop("text")
    got = bytes_of.join(per_text, null_safe(bytes_of, per_text, ["doc_id", "text_hash"])).select("bytes", F.explode("wanted").alias("w"))
    cut = got.select(
        F.col("w.key").alias("part"), F.col("w.key").alias("key"), F.col("w.strip").alias("strip"), F.col("w.n").alias("n"),
        (F.col("w.anchor") - F.col("w.hi")).alias("least"), (F.col("w.anchor") - F.col("w.lo")).alias("most"),
        F.substring(F.col("bytes"), F.col("w.lo") + 1, F.col("w.anchor") - F.col("w.lo")).alias("before"),
        F.substring(F.col("bytes"), F.col("w.anchor") + 1, F.col("w.hi") + length - F.col("w.anchor")).alias("after"))
    # A row that the table holds twice gives its strips twice.
    members = materialize(cut.dropDuplicates(["key", "strip"]))
    shared = shared_runs(members, length, group, reach)
    whole = classes.where("n > 1").select("key", "strip", F.array(F.struct((F.col("at.anchor") - F.col("at.hi")).alias("first"), (F.col("at.anchor") - F.col("at.lo")).alias("last"))).alias("runs"))
    runs = whole.unionByName(shared).select("key", "strip", F.explode("runs").alias("run"))
    spans = live.join(runs, ["key", "strip"]).select(
        "doc_id", "text_hash", F.struct((F.col("anchor") - F.col("run.last")).alias("first"), (F.col("anchor") - F.col("run.first") + length).alias("stop")).alias("span"))
    return spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted ranges joined where they touch."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["first"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["first"], s["stop"]))
    return out


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the characters that lie in them in part only."""
    out = []
    for first, stop in runs:
        while first < stop and data[first] & 0xC0 == 0x80:
            first += 1
        while first < stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if first < stop:
            out.append((first, stop))
    return out


def remove_repeats(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP,
    characters: bool = False, carry: list[str] | None = None, reach: int = REACH,
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, carried) of every row.

    A byte is removed if a string of ``length`` bytes that also starts
    anywhere else, in this document or another, covers it; all of that is
    judged on the input.  ``spans`` are the maximal removed byte ranges,
    (first, stop), ``kept`` the remaining bytes.  With ``characters`` a
    character that would be removed in part stays, so that ``kept`` is text.
    ``carried`` holds the columns ``carry``.  ``length`` is at least
    ``reach`` + 44; a smaller ``reach`` allows shorter strings and makes more
    strips.  A null text counts as empty; texts shorter than ``length`` stay
    as they are; repeated rows are documents of their own, so that they remove
    each other; null ids are ids like others; an empty table gives no rows.
    Other columns are not read.
    """
    if length < reach + BEYOND:
        raise ValueError(f"length must be at least {reach + BEYOND}")
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "carried")
    spans = repeated_spans(rows.drop("carried"), length, group, reach)
    joined = rows.join(spans, null_safe(rows, spans, ["doc_id", "text_hash"]), "left").select(rows["doc_id"], rows["text"], spans["spans"], rows["carried"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                gone = merged(found.as_py() or [])
                gone = whole_characters(data, gone) if characters else gone
                edges = [0, *[x for r in gone for x in r], len(data)]
                sizes.append(len(data))
                runs.append([{"first": a, "stop": b} for a, b in gone])
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()), batch.column(3)], names=["doc_id", "n_bytes", "spans", "kept", "carried"])

    kind = joined.schema["carried"].dataType.simpleString()
    return joined.mapInArrow(each, f"doc_id long, n_bytes long, spans array<struct<first:int,stop:int>>, kept binary, carried {kind}")


def digests(removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of ``remove_repeats``'s rows.

    ``text`` is what is kept; bytes of a character that was removed in part
    are replaced there (U+FFFD), while the digest is that of the bytes.
    """
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["first"])
    return removed.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
