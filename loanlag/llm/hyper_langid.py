"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram is its letters'
vectors, rotated by their place and multiplied (bound).  A text is the sum
(bundle) of its trigrams' vectors, a language the sum of its learning texts'
vectors at unit length.  A text gets the language whose prototype has the
largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 8
#: Different texts that a language is learned from, at most, those of the smallest hashes.
SAMPLE_PER_LANGUAGE = 2000
#: Trigram vectors that a Python worker keeps; beyond it they are made anew.
KNOWN_TRIGRAMS = 32_000
#: Unit vectors are summed as integers of this scale, so that the sums do not depend on the order.
SCALE = 1 << 20
#: Languages at most: their prototypes go through the driver and to every task, 8 KB each.  ISO 639-3 names fewer than 8,000.
MAX_LANGUAGES = 10_000
#: The cosine of a text with a language it has nothing of deviates from 0 by 1/sqrt(dimensions); up to so many deviations are noise.
NOISE = 5
#: Trigrams from which on a text of a learned language clears all of the noise bound; with fewer the bound falls with their square.
ENOUGH_TRIGRAMS = 64
UNKNOWN = "und"
BLANK = 32


class Space:
    """Letter and trigram vectors, made when first needed, the same in every process."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter: dict[int, bool] = {BLANK: False}
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, self.dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= KNOWN_TRIGRAMS:
                self.letters = {}
            self.letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def row(self, trigram: int) -> int:
        if trigram not in self.rows:
            at = len(self.rows)
            if at == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            a, b, c = trigram >> 42, trigram >> 21 & 0x1FFFFF, trigram & 0x1FFFFF
            self.vectors[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            self.rows[trigram] = at
        return self.rows[trigram]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Trigrams of the text's letters in lower case and their counts; runs of other characters are one blank.  None without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        kinds, which = np.unique(codes, return_inverse=True)
        for k in kinds.tolist():
            if k not in self.is_letter:
                self.is_letter[k] = chr(k).isalpha()
        letters = np.array([self.is_letter[k] for k in kinds.tolist()], dtype=bool)
        if not letters.any():
            return None
        codes = np.concatenate([[BLANK], np.where(letters, kinds, BLANK)[which], [BLANK]])
        codes = codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]
        return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The text's vector at unit length; None without letters."""
        found = self.trigrams(text) if text else None
        return None if found is None else self.bundle_of(found)

    def bundle_of(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The vector of trigrams and their counts, at unit length."""
        if len(self.rows) > KNOWN_TRIGRAMS:
            self.forget()
        rows = [self.row(t) for t in found[0].tolist()]
        counts, vector = found[1].astype(np.float32), np.zeros(self.dimensions, dtype=np.float32)
        # einsum: a product by BLAS would start threads in every worker of a machine.
        for at in range(0, len(rows), 1024):
            vector += np.einsum("i,ij->j", counts[at:at + 1024], self.vectors[rows[at:at + 1024]].astype(np.float32))
        norm = float(np.linalg.norm(vector))
        return vector.astype(np.float64) / norm if norm else np.zeros(self.dimensions)


def spread(counts: np.ndarray) -> float:
    """How many trigrams, all as frequent, would vary as much as those of ``counts``: a text of one word over and over has few."""
    n = counts.astype(np.float64)
    return float(n.sum() ** 2 / (n ** 2).sum())


def above_noise(score: Column, trigrams: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a score says more than chance does for a text of that spread."""
    share = F.least(F.lit(1.0), trigrams / ENOUGH_TRIGRAMS)
    return score > F.lit(NOISE / dimensions ** 0.5) * share * share


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: CRC-32 of its id, as text, is 2 modulo 4.  A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language, at unit length, from a sample of at most ``per_language`` different texts of each.

    Rows without text or language teach nothing.  The tasks' sums are added
    up by language before the driver gets one vector of each.  More than
    ``MAX_LANGUAGES`` different values of ``lang_col`` are refused with a
    ValueError.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("hash")
    limits = rows.select("lang", "hash").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).groupBy("lang").agg(F.max("hash").alias("limit"))
    if limits.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} different values")
    # One row a language: sent to every task, so that the texts are not shuffled by language.
    sample = rows.join(F.broadcast(limits), "lang").where("hash <= limit").groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, totals = Space(dimensions), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vector = space.bundle(text.as_py())
                if vector is not None:
                    totals[lang] = totals.get(lang, 0) + np.rint(vector * SCALE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.int64()))], names=["lang", "total"])

    parts = sample.mapInArrow(sums, "lang string, total array<long>").select("lang", F.posexplode("total").alias("at", "x"))
    added = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("total"))
    totals = {r.lang: np.array(r.total, dtype=np.int64) for r in added.select("lang", F.col("total.x").alias("total")).collect()}
    return {lang: t / max(np.linalg.norm(t), 1.0) for lang, t in sorted(totals.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None, trigrams: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred and score, and with ``trigrams`` also that, the ``spread`` of the text's.

    ``score`` is the largest cosine, at least 0, to six digits; ties go to
    the first language by name.  Without a letter, or with nothing learned,
    the language is ``und`` and the score 0.  Only the text is looked at;
    columns of ``keep`` must not have the names of the new ones.
    """
    kept = keep or []
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names])
    rows = docs.select(*kept) if text_col in kept else docs.select(*kept, text_col)
    at = rows.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(matrix.shape[1]) if names else None
        for batch in batches:
            langs, scores, spreads = [], [], []
            for text in batch.column(at):
                text = text.as_py()
                found = space.trigrams(text) if space and text else None
                vector = space.bundle_of(found) if found is not None else None
                cosines = matrix @ vector if vector is not None else None
                best = int(np.argmax(cosines)) if cosines is not None else None
                langs.append(UNKNOWN if best is None else names[best])
                scores.append(0.0 if best is None else round(min(max(float(cosines[best]), 0.0), 1.0), 6))
                spreads.append(0.0 if found is None else spread(found[1]))
            columns = [*[batch.column(i) for i in range(len(kept))], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            more = [pa.array(spreads, pa.float64())] if trigrams else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*kept, "lang_pred", "score", *["trigrams"] * trigrams])

    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[:len(kept)])
    return rows.mapInArrow(each, f"{schema}lang_pred string, score double" + ", trigrams double" * trigrams)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out.

    A null id counts as not held out, but teaches nothing.  Repeated rows
    each have a result; equal texts teach once; an empty table gives no
    rows.  More than ``MAX_LANGUAGES`` languages are refused.  Other columns
    are not read.
    """
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    prototypes = learn(known, text_col, lang_col, per_language)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, prototypes, keep=["doc_id", "held_out"])
