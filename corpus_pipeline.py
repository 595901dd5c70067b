"""A corpus pipeline: toxicity, quality, near duplicates, source mix, encoding.

Every stage reads what the stage before it kept, written as Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import bpe, mixing, quality, shingles, toxicity
from memloom.llm.scratch import Scratch, cleared


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents scored as toxic."""
    return toxicity.reject(docs, _labels(spark, sf_dir))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents voted as poor."""
    return quality.keep(docs, _labels(spark, sf_dir))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard 0.8 or more), the one with the smallest id."""
    return shingles.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents up to their source's target, each as often as the mix repeats it; those of better quality sooner.

    The scores come from a classifier fitted on all labelled documents: among those that the stages before have kept hardly a poor one is left to learn from.
    """
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.take(docs, quality.score_column(quality.fit(known, _labels(spark, sf_dir)), spark, F.col("text")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, n_tokens, ids_sha256, decoded_sha256)`` of each row taken; null text counts as empty, texts are encoded whole."""
    coded = bpe.encode_digest_column(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", "source", coded.alias("c")).select("doc_id", "source", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: No SQL can express these stages; tests hold each against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all stages; an empty table gives none. A stage's input and the tables it made go once its output is written."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with cleared():
            docs = scratch.save(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
