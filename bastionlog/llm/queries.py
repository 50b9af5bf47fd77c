"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bastionlog.llm import (
    bpe, chat, collocations, decontaminate, neighbours, packing, prefixes, quality, secrets, simhash, substrings, toxicity, warc,
)
from bastionlog.llm.tables import table
from bastionlog.session import materialise

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACKED_VOCABULARY = "word_bpe_49k.json"


def query(f):
    REGISTRY[f.__name__] = f
    return f


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived and read back."""
    return warc.archived(spark, table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("url")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.token_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def secret_table(docs: DataFrame) -> DataFrame:
    """Findings by blob of ``docs`` (text), written to the shared folder, as is the ledger."""
    ledger = materialise(secrets.scan_unseen(docs.select("text")), "secret-ledger")
    return materialise(secrets.findings_by_blob(ledger), "secret-findings")


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a ledger that begins empty."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets.secret_findings(docs, secret_table(docs))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.quality_scores(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back, and one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat.conversation_digests(chat.segments(rows.unionByName(chat.probe(spark))))


@query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without passages that stand earlier."""
    return substrings.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).drop(
        "longest_words", "longest_start", "longest_item", "spans"
    )


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2,048 ids."""
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(PACKED_VOCABULARY))


@query
def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"))
