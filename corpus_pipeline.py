"""From raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is stored as Parquet and is the
next one's ``docs``. Readers of files don't keep the order of rows, so packing derives the mixing stage's
positions again from its rows: shards are stretches of the mix, and sequences are numbered along it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from maskloom.llm import quality, secrets
from maskloom.llm.common import free_name, stored, table
from maskloom.llm.mixing import mixed, positioned
from maskloom.llm.near import keep_one
from maskloom.llm.packing import pack_documents

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of documents."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[secret]`` in place of each secret."""
    return secrets.redacted(docs, secrets.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, interleaved by target weights."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; documents are dealt in mixed order."""
    at = free_name(docs, "mix_at")
    return pack_documents(positioned(docs, at), public_tokenizers.path(TOKENIZER), order=at)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the mixing has an SQL form; the tests hold the pipeline against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
