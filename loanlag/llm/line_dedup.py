"""Dropping lines that many documents share.

Lines are exploded, normalised and hashed; documents are counted per hash,
and lines over the threshold go except in one document.  What stays of a
document is put together again by the lines' positions.  Only DataFrame
functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, null_safe, text_hash

#: White space that is stripped from both ends of a line.
WHITE = "\t\n\v\f\r "
#: Columns that name a line: 128 bits of hash, so that different lines stay apart in any corpus.
KEY = ["key_1", "key_2"]


def keyed_lines(docs: DataFrame, min_length: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_hash, pos, key_1, key_2) of every line whose normalised form has ``min_length`` code points or more."""
    lowered = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("row_hash"),
        F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase).alias("text"))
    lines = lowered.select("doc_id", "row_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(WHITE))
    return lines.where(F.length(line) >= min_length).select(
        "doc_id", "row_hash", "pos", F.xxhash64(line).alias("key_1"), F.xxhash64(F.lit("line"), line).alias("key_2"))


def shared_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """(key_1, key_2, documents, largest) of the lines found in ``min_documents`` documents or more; ``largest`` is the largest id.

    Documents are distinct ids; all rows without an id are one document.
    Ids are counted after a partial count in each task, so a line that
    stands in a third of all documents does not meet in one task.
    """
    no_id = F.max(F.col("doc_id").isNull().cast("long"))
    counted = lines.groupBy(*KEY).agg((F.count_distinct("doc_id") + no_id).alias("documents"), F.max("doc_id").alias("largest"))
    return counted.where(F.col("documents") >= min_documents)


def drop_shared_lines(docs: DataFrame, min_length: int = 40, min_documents: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row: its text without the lines that many documents share.

    A line's key is the line without ``WHITE`` at its ends, with A-Z in lower
    case.  Keys of at least ``min_length`` code points found in at least
    ``min_documents`` documents lose all their lines, except in the document
    of the largest id that holds them.  A null or empty text is one empty
    line.  Rows of one id are one document: what goes from one goes from all.
    Null ids are one document, smaller than any other.  Repeated rows each
    have a result; an empty table gives no rows.  Other columns are not read.
    """
    lines = keyed_lines(docs, min_length, id_col, text_col)
    # Written first: the join's sides are then plain shuffles, which Spark may split where a line is hot or broadcast if measured small.
    shared = materialize(shared_lines(lines, min_documents).select(*[F.col(k).alias(f"of_{k}") for k in KEY], "largest"))
    goes = lines.join(shared, [lines[k] == shared[f"of_{k}"] for k in KEY]).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    places = goes.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("places")).select(
        F.col("doc_id").alias("of_id"), F.col("row_hash").alias("of_hash"), "places")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("row_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = rows.withColumns({"of_id": F.col("doc_id"), "of_hash": F.col("row_hash")})
    joined = keys.join(places, null_safe(keys, places, ["of_id", "of_hash"]), "left").select("doc_id", "text", places["places"])
    split = F.split("text", "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("places"))
    # A line is fetched by its place: get() of a position that exists.
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(split, i)), "\n"))
    return joined.select(
        "doc_id", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def digests(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of ``drop_shared_lines``'s rows."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle(min_length: int = 40, min_documents: int = 5) -> str:
    """DuckDB SQL for the digests over ``documents``."""
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    return f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents),
    keyed AS (
        SELECT *, translate(trim(line, {white}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM lines),
    shared AS (
        SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= {min_length}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {min_documents}),
    judged AS (
        SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.largest AS goes
        FROM keyed k LEFT JOIN shared s ON k.key = s.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
    FROM judged GROUP BY doc_id"""
