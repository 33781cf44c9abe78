"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes every stage's
rows as Parquet to the cluster's shared folder and rereads them as the next stage's documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name.  A null text counts as empty: it has the quality of a text without words, is nobody's copy, holds no secret, has no
tokens, and is told as no ids.  Rows with a null doc_id are documents of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, mixing, neardup, quality, queries, secrets
from foliant.llm.common import scratch, tasks_for, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality classifier rejects; equal texts fare alike."""
    return quality.accepted(docs, quality.fit(docs, queries.table(spark, sf_dir, "labels")), threshold=0.3)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, similarity of 0.8 or more): the smallest doc_id, one
    row of it."""
    return neardup.deduplicated(docs, words=5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found in a text; n_chars follows; a null text stays null."""
    return secrets.redact(docs, secrets.train(secrets.findings()))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows so that the languages' tokens reach the target weights; none is lost."""
    return mixing.mixed(docs, queries.domains(docs), queries.WEIGHTS, least=1.0)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of each row; a text without characters has none."""
    return bpe.encode_documents(docs, *queries.vocabulary())


STAGES = [("quality classifier", good_quality), ("near-duplicates", without_copies), ("secrets", without_secrets), ("mixing", to_weights), ("byte-level BPE", to_tokens)]

#: SQL can express neither the trained stages nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # a stage's own tables go as soon as its rows are written
            n = tasks_for(docs)
            made = stage(spark, docs.coalesce(n), sf_dir).coalesce(n)
            docs = written(made, "stage-" + name.replace(" ", "-"), keep=True)
    return docs
