"""The corpus pipeline: five operators over documents, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from corpusloom.llm import curriculum_mix, language_mixture, neardup_hamming, piece_viterbi, quality_fm
from corpusloom.llm._store import discard, kept, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those of no dominant or of unknown language go."""
    return language_mixture.accepted(docs, language_mixture.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient quality."""
    return quality_fm.accepted(docs, quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup_hamming.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the training mix, in curriculum order; a repeated document is repeated rows."""
    return curriculum_mix.curriculum(docs).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of each row of the mix."""
    return piece_viterbi.encoded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: The classifiers' scores can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again before the next; a stage's table goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            before, docs = docs, kept(stage(spark, docs, sf_dir), f"stage{k}", outlives=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
