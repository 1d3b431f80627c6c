"""A training corpus from ``documents``: identified, without near copies, redacted, mixed and encoded.

Each stage takes (spark, docs, sf_dir), with the columns of documents, and works on all that its predecessor
kept. Models and plans (languages, secrets, mix) are learned from the stage's own input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinetra.llm import bpe, mixing, near_copies, ppm_lang, secret_scan
from kinetra.llm.common import DOCUMENT_COLUMNS, documents, materialize, small_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter or with a score under one half go."""
    small_batches(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    return ppm_lang.keep_identified(docs, ppm_lang.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document of smallest id."""
    small_batches(spark)
    return near_copies.keep_one(docs.select(*DOCUMENT_COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    small_batches(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    return secret_scan.redact(docs, secret_scan.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources uses them."""
    return mixing.take(docs.select(*DOCUMENT_COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``(doc_id, ids, n_tokens)``."""
    small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("bpe_encode", encode_tokens),
]

#: The language model, the network and the fingerprints can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
