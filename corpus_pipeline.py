"""From raw documents to encoded training text in five stages.

Each stage takes (spark, docs, sf_dir), works on all the stage before kept, and returns
documents with the same columns, the last one their encodings. ``run`` writes every stage's
result to the shared folder and reads it again, so a lost executor costs one stage's tasks.
A stage on an empty table returns an empty one; nulls, ties and long texts are handled as the
operators' docstrings say. Rows with a null id count as documents of their own, except that
quality rules drop null texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import parity_join, pii, quality_rules, sentencepiece_codec, source_mix
from rollcall.workdir import settle

MODEL = "piece_bpe_32k.model"
SHINGLE_WORDS = 5
SIMILARITY = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the threshold table keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return parity_join.first_of_groups(docs, SHINGLE_WORDS, SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced."""
    return pii.redact(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mix.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ids with the end id, their number, and the decoded text."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_weights),
    ("SentencePiece encoding and decoding", encoding),
]
# Neither the joins' components nor the encoding can be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return docs
