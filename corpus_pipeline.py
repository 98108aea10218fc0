"""A corpus pipeline: language ID, exact dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame, which run()
writes and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, decontam, exact_dedup, langid, near_copies
from palimpsest.llm.common import stage, table, without
from palimpsest.llm.queries import VOCABULARY

#: SQL cannot express the model, the fingerprints and the tokens; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, and those whose likeliest language has a probability below langid.LEAST."""
    return langid.keep_known(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays."""
    return exact_dedup.first_of_equals(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with five-word shingles alike to 0.8, by their sets, the smallest doc_id stays."""
    said = stage(near_copies.near_copies(docs).filter("not doc_id <=> component_id").select("doc_id"), "near")
    return without(docs, said)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which a benchmark item is found."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids: each whole text encoded, and decoded again for its hash."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
