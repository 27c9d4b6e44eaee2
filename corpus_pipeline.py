"""From documents to token ids: five stages over the columns of the documents table.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; its result is
written as Parquet to the shared folder and read back as the next one's docs. All but the last
return the columns of docs. An empty table passes through every stage; null texts and ids are
handled as the operators' docstrings say; other columns are carried along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm import bpe, jaccard_join, langid, mixing, secrets
from folioquery.llm.common import id_fold, materialize, table

#: SQL cannot express a trained language identifier or the byte-pair merges.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that are rejected go."""
    held = F.coalesce(id_fold("doc_id", 4) == 2, F.lit(True))
    return langid.keep_identified(docs, langid.fit(docs, ~held))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id."""
    return jaccard_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted anew."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them; a document taken twice stands twice."""
    return mixing.apply(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
