"""One query per operator over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    hash_tree, hyper_langid, license_rules, line_dedup, permutation_index, phrase_mining, pivot_table, simhash_cover, source_mix, suffix_dedup, token_alignment,
    token_blocks, tree_bpe)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five approximate neighbours by cosine of every 50th vector."""
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest integer inner products of every 50th vector, exact."""
    return pivot_table.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, and where they lie with one shard more."""
    docs = table(spark, sf_dir, "documents")
    return hash_tree.assign(docs, hash_tree.layout(SHARDS), hash_tree.layout(SHARDS + 1))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of all documents."""
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles of all documents, linked within 4 bits."""
    found = simhash_cover.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=4)
    return found.select("doc_id", simhash_cover.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the lower-case word vocabulary."""
    return tree_bpe.digests(tree_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 400-byte strings."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400))


def op8_hyper_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    return hyper_langid.identify(table(spark, sf_dir, "documents"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and rule detections of all documents."""
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written as packed blocks and read back."""
    return token_blocks.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two tokenizers aligned, with corpus-wide counts of linked ids."""
    return token_alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five or more share."""
    return line_dedup.digests(line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), min_length=40, min_documents=5))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language, mined from all documents."""
    return phrase_mining.mine(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_permutation_index, op2_pivot_table, op3_hash_tree, op4_source_mix, op5_simhash_cover, op6_tree_bpe, op7_suffix_dedup, op8_hyper_langid,
        op9_license_rules, op10_token_blocks, op11_token_alignment, op12_line_dedup, op13_phrase_automata)
}

ORACLE_SQL: dict[str, str] = {
    "op3_hash_tree": hash_tree.oracle(hash_tree.layout(SHARDS), hash_tree.layout(SHARDS + 1)),
    "op4_source_mix": source_mix.oracle(),
    "op9_license_rules": license_rules.oracle(),
    "op12_line_dedup": line_dedup.oracle(),
    "op13_phrase_automata": phrase_mining.oracle(),
}
