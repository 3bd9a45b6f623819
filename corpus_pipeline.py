"""The corpus pipeline: stages run one after another over documents, each written as Parquet and read again.

Documents without a language go, then all but the smallest doc_id of each group of near-duplicates; secrets are
marked out, sources are mixed to their weights, and what the mix holds is packed into token sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tendergrid.llm.common import shared_dir
from tendergrid.llm.language_id import in_known_languages
from tendergrid.llm.mixing import mixed_documents
from tendergrid.llm.near_dedup import keep_one_of_each
from tendergrid.llm.packing import pack_documents
from tendergrid.llm.secrets import redact

#: Score under which a document is in no learned language: nearly all its n-grams lie outside the nearest profile.
LEAST_SCORE = 0.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is in a learned language; null texts, texts without letters and texts unlike any profile go."""
    return in_known_languages(docs, LEAST_SCORE)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates on five-word shingles."""
    return keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets marked out."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each time it is taken."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences, a row per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]
#: Language profiles, the battery and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
