"""Corpus preparation in five stages, each a table of documents that the next one reads.

documents: doc_id, text, source, and any other columns, whatever their names; the stages but the last return them all.
Null and empty texts pass through the first three stages; the mix takes none, as they have no words. Empty tables stay
empty in every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytolake.llm.bpe import encode_documents
from cytolake.llm.common import materialize, read_table
from cytolake.llm.mixing import mixed_documents
from cytolake.llm.ngram_join import one_of_each
from cytolake.llm.secrets import redact
from cytolake.llm.toxicity import without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. A row is judged by its text alone: null and empty texts like others, repeated rows
    alike."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id (a null id is the largest), then the smallest
    hash of the text. Null and empty texts have no duplicates and stay."""
    return one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; every document stays. Rows with the same id and text are masked alike; null texts
    stay null."""
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents left out, kept or repeated. Texts without words are left out; a null source
    is one of its own; rows that repeat an id are told apart by their texts, equal rows counted off."""
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the decoded text. Each row is encoded by its text
    alone, in parts if it is long; null and empty texts have no ids."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Learned stages have no SQL form; tests hold run() against the stages done one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
