"""Corpus preparation in stages, each calling one operator of marlstone.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns the encoded documents. Nulls and repeated rows are treated as the operators say.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, lines, mixing, quality, simhash
from marlstone.llm._common import cut, small_batches

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; every document stays, if with less text."""
    return lines.remove_later(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity of five-word shingles >= 0.8) the document with the smallest id stays."""
    return simhash.keep_one(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all up to three times, longer ones more often."""
    return mixing.mix(docs, weight=mixing.by_length())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ids are packed little-endian 32-bit integers."""
    return bpe.round_trip(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)


def _stage(work):
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return work(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("line dedup", _stage(line_dedup)),
    ("simhash near-dedup", _stage(near_dedup)),
    ("mix sources", _stage(mix_sources)),
    ("byte-level bpe", _stage(encode)),
]
#: The stages' models and fingerprints are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
