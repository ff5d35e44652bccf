"""Phrases that stand together more often than their parts suggest.

Shards of text are counted into weighted automata (``count_automata``), which
are dealt out by the words their phrases begin with, united there and summed by
prefix range.  Words are counted first, then pairs of frequent words, then longer
phrases along frequent pairs: a phrase is no more frequent than its parts.
At last candidates' parts are looked up by composition with the automata of
frequent phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import hot_keys
from .common import materialize
from .count_automata import NO_WORD, CountAutomaton, numbered, rows_of

#: Bytes of text that are counted as one shard.
SHARD_BYTES = 1 << 23
#: Bytes of phrases that are united at once.
UNITED_BYTES = 1 << 23
#: Words of the corpus for each bucket of states.
BUCKET_WORDS = 200_000
#: A state with more windows than this is dealt out by the word that follows; beyond ``hot_keys``'s bound of states, than their share.
HOT_STATE = 2_000_000
#: The filter of phrases that may be frequent has 2 to this power of bits at any input: beyond it, it lets more through.
FILTER_BITS = 26
#: Phrases and parts in one group of the composition, about.
COMPOSED_AT_ONCE = 50_000
#: A part that more cuts ask for is looked up in several groups.
HOT_PART = 50_000

SEPARATORS = np.zeros(256, dtype=np.uint8)
SEPARATORS[list(b" \t")] = 1
SEPARATORS[list(b".,;:!?\n\v\f\r")] = 2

FOLD, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts with A-Z in lower case: their numbers, the word of each number, the text and the piece that each stands in."""
    lowered = pc.ascii_lower(texts).cast(pa.large_binary())
    at = np.frombuffer(lowered.buffers()[1], np.int64, len(texts) + 1, lowered.offset * 8)
    data = np.frombuffer(lowered.buffers()[2], np.uint8)[at[0]:at[-1]] if at[-1] else np.array([], dtype=np.uint8)
    at = at - at[0]
    kind = SEPARATORS[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    start = np.flatnonzero(begins)
    offsets = np.append(start - np.searchsorted(np.flatnonzero(kind), start), inside.sum()).astype(np.int64)
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    numbers, words = numbered(cut)
    return numbers, words, np.searchsorted(at, start, side="right") - 1, np.searchsorted(np.flatnonzero(kind == 2), start)


def word_hashes(langs: list[str], words: list[bytes]) -> np.ndarray:
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in zip(langs, words, strict=True)), dtype=np.uint64, count=len(words))


def bits_at(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes * SPREAD) >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Dealt:
    """Deals the phrases that begin with the same words out to one bucket, those of hot states to several by the word that follows."""

    def __init__(self, buckets: int, hot: dict[int, int]):
        self.buckets = np.uint64(buckets)
        self.hot = np.array(sorted(hot), dtype=np.uint64)
        self.into = np.array([hot[h] for h in sorted(hot)], dtype=np.uint64)

    def bucket(self, states: np.ndarray, following: np.ndarray) -> np.ndarray:
        """The buckets, from the hashes of the states and of the words that follow."""
        part = np.zeros(len(states), dtype=np.uint64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, states), len(self.hot) - 1)
            part = np.where(self.hot[at] == states, following % self.into[at], part)
        return ((((states ^ (part * FOLD)) * SPREAD) >> np.uint64(20)) % self.buckets).astype(np.int64)


def joined(lists: np.ndarray, words: pa.Array, by: str) -> pa.Array:
    """The words of lists of which ``lists`` gives the ends, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lists]).astype(np.int32)), words), by)


class Shard:
    """The words of some texts; a word's number also tells the language."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        numbers, words, text, piece = words_of(texts)
        of_lang, self.langs = numbered(langs)
        seen, self.words = np.unique(of_lang[text] * len(words) + numbers, return_inverse=True)
        self.word_of, self.lang_of = words.take(pa.array(seen % max(len(words), 1))).cast(pa.large_string()).cast(pa.string()), seen // max(len(words), 1)
        self.goes_on = np.zeros(len(numbers), dtype=bool)
        self.goes_on[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])

    def languages(self, words: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.lang_of[words]))

    def hashes(self) -> np.ndarray:
        return word_hashes(self.langs.take(pa.array(self.lang_of)).to_pylist(), self.word_of.cast(pa.binary()).to_pylist())

    def unigrams(self) -> tuple[list, list[str]]:
        counts = np.bincount(self.words, minlength=len(self.lang_of))
        totals = np.bincount(self.lang_of, counts, len(self.langs)).astype(np.int64)
        lang = pa.concat_arrays([self.languages(np.arange(len(self.lang_of))), self.langs])
        word = pa.concat_arrays([self.word_of, pa.nulls(len(self.langs), pa.string())])
        return [lang, word, pa.array(np.concatenate([counts, totals]))], ["lang", "phrase", "f"]

    def windows(self, head: int, tail: int, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """One row for each window of ``head`` words and one to ``tail`` more, as far as phrases of ``head`` words may be frequent."""
        folded, n = hashes[self.words], len(self.words)
        whole = np.ones(n, dtype=bool)
        for k in range(1, head):
            whole[n - k:] = False
            whole[:n - k] &= self.goes_on[k - 1:n - 1]
            folded[:n - k] = folded[:n - k] * FOLD + hashes[self.words[k:]]
        # Whether a phrase of ``head`` words that may be frequent begins at a place; a window goes on as long as the next place has one.
        may = whole & bits_at(bits, folded)
        steps = np.zeros((tail, n), dtype=bool)
        alive = may
        for k in range(tail):
            at = head + k
            if at < n:
                steps[k, :n - at] = alive[:n - at] & self.goes_on[at - 1:n - 1] & may[k + 1:n - at + k + 1]
            alive = steps[k]
        begin = np.flatnonzero(steps[0])
        rows = np.full((len(begin), head + tail), NO_WORD, dtype=np.int64)
        for k in range(head + tail):
            long = slice(None) if k <= head else np.flatnonzero(steps[k - head, begin])
            rows[long, k] = self.words[begin[long] + k]
        return rows

    def arcs(self, head: int, tail: int, bits: np.ndarray, dealt: Dealt) -> tuple[list, list[str]]:
        """The shard's automaton of windows, one row for a language and bucket: its phrases in order, line by line, with their counts."""
        hashes = self.hashes()
        rows = self.windows(head, tail, bits, hashes)
        automaton = CountAutomaton.united(rows, np.ones(len(rows), dtype=np.int64))
        rows, counts = automaton.rows, automaton.counts
        states = hashes[rows[:, 0]]
        for k in range(1, head):
            states = states * FOLD + hashes[rows[:, k]]
        bucket, lang = dealt.bucket(states, hashes[rows[:, head]]), self.lang_of[rows[:, 0]]
        order = np.lexsort((bucket, lang))
        rows, counts, bucket, lang = rows[order], counts[order], bucket[order], lang[order]
        begin = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1])])) if len(rows) else np.array([], dtype=np.int64)
        long = rows != NO_WORD
        phrases = joined(np.cumsum(long.sum(axis=1)), self.word_of.take(pa.array(rows[long])), " ")
        ends = np.append(begin[1:], len(rows)) if len(begin) else begin
        return [
            self.langs.take(pa.array(lang[begin])), pa.array(bucket[begin]), joined(ends, phrases, "\n"),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(counts)),
        ], ["lang", "bucket", "phrases", "counts"]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Texts in shards of about ``SHARD_BYTES``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD_BYTES:
            yield shard_of(held)
            held, size = [], 0
    if held:
        yield shard_of(held)


def shard_of(batches: list[pa.RecordBatch]) -> Shard:
    column = lambda k: pa.concat_arrays([b.column(k).cast(pa.large_string()) for b in batches])
    return Shard(column(0), column(1).cast(pa.string()))


def rows_in(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))


def frequent_words(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of the words found ``least`` times or more, and (lang, n) with all occurrences of words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            columns, names = shard.unigrams()
            yield pa.RecordBatch.from_arrays(columns, names=names)

    counted = rows.mapInArrow(each, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    kept = materialize(counted.where(F.col("phrase").isNull() | (F.col("f") >= least)))
    return kept.where(F.col("phrase").isNotNull()), kept.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))


def filter_bits(phrases: DataFrame) -> np.ndarray:
    """The filter of all phrases (lang, phrase): 2^FILTER_BITS bits, whatever the input."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                langs = batch.column(0).to_pylist()
                split = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
                folded = word_hashes(langs, [w[0] for w in split])
                for k in range(1, max(map(len, split))):
                    of = np.array([i for i, w in enumerate(split) if len(w) > k])
                    folded[of] = folded[of] * FOLD + word_hashes([langs[i] for i in of], [split[i][k] for i in of])
                yield pa.RecordBatch.from_arrays([pa.array(((folded * SPREAD) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) + 1)], names=["place"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "place long").groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for bucket, bits in found.collect():
        out[(bucket - 1) * len(bits):bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def dealing(phrases: DataFrame, total: int, hot_state: int, windows: int) -> Dealt:
    """One bucket for each ``windows`` words of ``total``; several for the phrases that more than ``hot_state`` windows begin with, or the 100,000th part of all words if that is more.

    So hot phrases are fewer than 100,000.
    """
    target = max(hot_state, total // 100_000)
    found = [(lang, [w.encode() for w in phrase.split(" ")], f) for lang, phrase, f in phrases.where(F.col("f") > target).collect()]
    hot = {}
    for lang, words, f in found:
        hashes = word_hashes([lang] * len(words), words)
        state = hashes[:1]
        for k in range(1, len(words)):
            state = state * FOLD + hashes[k:k + 1]
        hot[int(state[0])] = -(-f // target)
    return Dealt(max(1, -(-total // windows)), hot)


def frequent_longer(rows: DataFrame, shorter: DataFrame, head: int, tail: int, least: int, dealt: Dealt) -> DataFrame:
    """(lang, phrase, f) of the phrases of more than ``head``, up to ``head + tail`` words, found ``least`` times or more; ``shorter`` holds those of ``head`` words."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(filter_bits(shorter))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            columns, names = shard.arcs(head, tail, bits.value, dealt)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    counted = rows.mapInArrow(count, "lang string, bucket long, phrases string, counts array<long>")
    sorted_rows = counted.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return materialize(sorted_rows.mapInArrow(uniting(head, tail, least), "lang string, phrase string, f long"))


def uniting(head: int, tail: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Unites the automata of each bucket, which come one after the other, and gives the phrases of more than ``head`` words that weigh ``least`` or more."""

    def union(buckets: pa.Table) -> tuple[CountAutomaton, np.ndarray, pa.Array]:
        group = np.cumsum(np.concatenate([[0], changes(buckets)]))[:buckets.num_rows]
        lines = pc.split_pattern(buckets["phrases"].combine_chunks(), "\n")
        rows, words = rows_of(lines.flatten())
        counts = buckets["counts"].combine_chunks().flatten().to_numpy()
        n = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        return CountAutomaton.united(np.column_stack([np.repeat(group, n), rows]), counts), group, words

    def frequent(buckets: pa.Table) -> pa.RecordBatch:
        automaton, group, words = union(buckets)
        first = np.searchsorted(group, np.arange(int(group[-1]) + 1))
        found = [(), (), ()]
        for length in range(head + 1, min(head + tail, automaton.rows.shape[1] - 1) + 1):
            rows, weights = automaton.prefixes(1 + length, least)
            found[0] += tuple(buckets["lang"].take(pa.array(first[rows[:, 0]])).to_pylist())
            found[1] += tuple(joined(np.arange(1, len(rows) + 1) * length, words.take(pa.array(rows[:, 1:].ravel())), " ").to_pylist())
            found[2] += tuple(weights.tolist())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "phrase", "f"])

    def summed(bucket: pa.Table) -> pa.Table:
        """The automata of one bucket as one row."""
        automaton, _, words = union(bucket)
        rows = automaton.rows[:, 1:]
        long = rows != NO_WORD
        phrases = joined(np.cumsum(long.sum(axis=1)), words.take(pa.array(rows[long])), " ")
        counts = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.array(automaton.counts))
        return pa.table([bucket["lang"][:1], bucket["bucket"][:1], joined(np.array([len(rows)]), phrases, "\n"), counts.cast(bucket["counts"].type)], schema=bucket.schema)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        limit = UNITED_BYTES
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.nbytes >= limit:
                last = np.flatnonzero(changes(held))
                at = int(last[-1]) + 1 if len(last) else 0
                if at:
                    yield frequent(held[:at].combine_chunks())
                # The last bucket may go on; what it has so far becomes one row.
                held = summed(held[at:].combine_chunks())
                limit = max(UNITED_BYTES, 2 * held.nbytes)
        if held is not None:
            yield frequent(held.combine_chunks())

    return unite


def changes(buckets: pa.Table) -> np.ndarray:
    """Whether each row but the first is of another language or bucket than the row before."""
    out = np.zeros(max(buckets.num_rows - 1, 0), dtype=bool)
    for name in ("lang", "bucket"):
        column = buckets[name].combine_chunks()
        out |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def looked_up(asked: DataFrame, phrases: DataFrame) -> DataFrame:
    """``asked`` (lang, part, ...) with ``f``, the weight that the automata of ``phrases`` (lang, phrase, f) give to each part.

    Both are dealt into groups by hash.  A part that many rows ask for is
    dealt into several groups, and its phrase is put into each.
    """
    keyed = lambda c: F.concat_ws("\n", "lang", c)
    hot = hot_keys(asked.select(keyed("part").alias("key")), "key", HOT_PART)
    groups = max(1, -(-max(asked.count(), phrases.count()) // COMPOSED_AT_ONCE))
    group = lambda c, salt: F.pmod(F.xxhash64("lang", c, salt), F.lit(groups)).cast("int")
    rest = [c for c in asked.columns if c not in ("lang", "part")]
    salt = F.when(F.col("_buckets").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rest), F.col("_buckets"))).cast("int")
    left = asked.withColumn("key", keyed("part")).join(F.broadcast(hot), "key", "left").select(*asked.columns, group("part", salt).alias("group"))
    # Salts may meet in one group, which gets the phrase once.
    salts = F.when(F.col("_buckets").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_buckets") - 1))
    right = phrases.withColumn("key", keyed("phrase")).join(F.broadcast(hot), "key", "left").select(
        "lang", "phrase", "f", F.explode(F.array_distinct(F.transform(salts, lambda s: group("phrase", s)))).alias("group"))

    def compose(parts: pa.Table, known: pa.Table) -> pa.Table:
        rows, _ = rows_of(pa.concat_arrays([known["phrase"].combine_chunks(), parts["part"].combine_chunks()]))
        langs, _ = numbered(pa.concat_arrays([known["lang"].combine_chunks(), parts["lang"].combine_chunks()]))
        rows = np.column_stack([langs, rows])
        automaton = CountAutomaton.united(rows[:known.num_rows], known["f"].to_numpy())
        return parts.drop_columns(["group"]).append_column("f", pa.array(automaton.compose(rows[known.num_rows:])))

    fields = ", ".join(f"{name} {kind}" for name, kind in asked.dtypes)
    return left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(compose, f"{fields}, f long")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang", hot_state: int = HOT_STATE,
         bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score.

    Texts with A-Z in lower case are split at ``[.,;:!?\\x0A-\\x0D]`` into
    pieces and those at blanks and tabs into words.  ``n`` counts a
    language's words, f(phrase) its places within pieces, overlaps included.
    Candidates are the phrases of 2 to ``longest`` words (3 at least) with
    a = f(phrase) of ``least`` or more.  A candidate cut in two with l and r
    scores floor(1000*a*n / (l*r)); its lowest cut counts, the smallest
    first part on ties.  One that lies in a longer candidate of equal count
    is dropped.  The order is by score and a, descending, then by phrase.

    A null language is ``und``; a null or empty text has no words; repeated
    rows count as often as they stand there; an empty table gives no rows.
    Other columns are not read.  Products have 38 digits.
    """
    rows = rows_in(docs, text_col, lang_col)
    words, totals = frequent_words(rows, least)
    total = totals.agg(F.sum("n")).first()[0] or 0
    pairs = frequent_longer(rows, words, 1, 1, least, dealing(words, total, hot_state, bucket_words))
    longer = frequent_longer(rows, pairs, 2, longest - 2, least, dealing(pairs, total, hot_state, bucket_words))
    phrases = words.unionByName(pairs).unionByName(longer)
    candidates = pairs.unionByName(longer).withColumn("words", F.split("phrase", " ")).withColumn("m", F.size("words"))

    # The cuts' parts, two a cut.
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    said = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    sides = F.array(F.struct(F.lit("l").alias("side"), said(F.lit(1), F.col("k")).alias("part")),
                    F.struct(F.lit("r").alias("side"), said(F.col("k") + 1, F.size("words") - F.col("k")).alias("part")))
    asked = cut.select("lang", "phrase", "a", "k", F.explode(sides).alias("x")).select("lang", "phrase", "a", "k", "x.side", "x.part")
    found = looked_up(asked, phrases)
    weight = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    parts = found.groupBy("lang", "phrase", "a").agg(*[weight(k, side).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scores = parts
    for k in range(1, longest):
        scores = scores.withColumns({f"up{k}": F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n")), f"down{k}": big(f"l{k}") * big(f"r{k}")})
    cuts = F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(
        F.expr(f"up{k} div down{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)])
    scored = scores.select("lang", "phrase", "a", "n", F.array_min(cuts).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    # If any longer candidate of equal count holds a phrase, one that is a word longer does.
    inner = F.array(F.array_join(F.slice("words", 1, F.col("m") - 1), " "), F.array_join(F.slice("words", 2, F.col("m") - 1), " "))
    within = candidates.where(F.col("m") > 2).select(F.col("lang").alias("of_lang"), F.explode(inner).alias("of_phrase"), "f").groupBy("of_lang", "of_phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(within, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("of_phrase")), "left").where(
        F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    # Each task hands on its own first rows of a language only.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "l", "r", "n", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """DuckDB SQL for ``mine`` over ``documents``."""
    return f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents),
    split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS words FROM pieces),
    starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS place FROM split),
    grams AS (SELECT lang, words, place, unnest(range(1, least({longest}, len(words) - place + 1) + 1)) AS m FROM starts),
    counted AS (
        SELECT lang, array_to_string(list_slice(words, place, place + m - 1), ' ') AS phrase, m, count(*) AS f
        FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang),
    frequent AS (SELECT lang, phrase, m, f, string_split(phrase, ' ') AS words FROM counted WHERE f >= {least}),
    cuts AS (SELECT lang, phrase, m, f AS a, words, unnest(range(1, m)) AS k FROM frequent WHERE m >= 2),
    scored AS (
        SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, t.n,
               (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
        FROM cuts c JOIN totals t USING (lang)
        JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.words, 1, c.k), ' ')
        JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.words, c.k + 1, c.m), ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (
        SELECT * FROM lowest c WHERE NOT EXISTS (
            SELECT 1 FROM lowest o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.a >= 100 * c.a
            AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""
