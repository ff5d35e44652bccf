"""Small tables with the cases that every operator must take."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = "size shard slot taken target key strip part n spans kept carried fp root anchor home near far ids score rank words before src block one __id __hash".split()


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) as a documents table with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHING])


LONG = "the quick brown fox jumps over the lazy dog, é è ü ß. " * 1500
EDGE = [
    (1, "under the MIT license, plainly said"), (2, None), (3, ""), (4, "   \n\t "), (None, "no id at all here"),
    (5, LONG), (6, LONG + "x"), (7, "same words for two rows"), (7, "same words for two rows"), (7, "other words for the same id"),
    (8, "x"), (9, "日本語 テキスト"), (10, "1234 5678 !!"), (None, None), (11, "word " * 50, None, None), (12, "word " * 50, "de", "t"),
    (-13, "negative id"), (14, "a<|endoftext|>b <|startoftext|>"), (15, "tab\there\r\nand there"),
]
