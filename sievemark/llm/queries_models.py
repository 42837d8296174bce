"""Queries on models: quality and language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_model, quality
from .tables import read


def op6_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by unigrams and by the mixed model; a seventh is held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = language_model.score(docs, ~held)
    return scored.select("doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def held_out_quality():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out quarter."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    found = quality.scored(docs, labels, ~held_out_quality())
    return found.select("doc_id", held_out_quality().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    "op5_quality_scores": op5_quality_scores,
    "op6_context_mixing_scores": op6_context_mixing_scores,
}
ORACLES: dict[str, str] = {}
