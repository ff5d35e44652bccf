"""From documents to token ids: five stages, each an operator of ``loanlag.llm``.

A stage gets all that the one before kept, written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlag.llm import hyper_langid, simhash_cover, source_mix, suffix_dedup, tree_bpe
from loanlag.llm.common import materialize, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a string whose repeats go: fewer than nearly all passages of 51 words have.  Its anchors lie among the first REPEAT_REACH places.
REPEAT_BYTES = 250
REPEAT_REACH = 128


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, those whose cosine is above noise; a missing ``lang`` becomes the predicted one."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    prototypes = hyper_langid.learn(docs.where(F.col("doc_id").isNotNull() & ~hyper_langid.held_out("doc_id")))
    judged = hyper_langid.predict(docs, prototypes, keep=COLUMNS, trigrams=True)
    kept = judged.where((F.col("lang_pred") != hyper_langid.UNKNOWN) & hyper_langid.above_noise(F.col("score"), F.col("trigrams")))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return simhash_cover.one_of_each(docs.select(*COLUMNS), shingle=4, threshold=4)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the characters that repeated strings of REPEAT_BYTES cover; ``n_chars`` is counted anew."""
    removed = suffix_dedup.remove_repeats(docs.select(*COLUMNS), length=REPEAT_BYTES, characters=True, carry=["lang", "source"], reach=REPEAT_REACH)
    text = F.col("kept").cast("string")
    return removed.select("doc_id", text.alias("text"), "carried.lang", "carried.source", F.length(text).cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as the schedule takes them; ``n_chars`` is counted anew."""
    return source_mix.mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digests of ids and decoding."""
    small_batches(spark)
    encoded = tree_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return encoded.select(
        "doc_id", "n_tokens", ids.alias("ids"), F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("source_mixing", source_mixing),
    ("bpe", tokenization),
]

#: Hashing, suffix arrays and merges are not for SQL; the tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
