"""Queries on near-duplicates, repeated passages and benchmark leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, minhash, passages
from .tables import read


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, by shingles of five words and similarity 0.75."""
    return minhash.groups(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=75, width=5)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at least 50 words that a document shares with another one."""
    return passages.repeated(read(spark, sf_dir, "documents").select("doc_id", "text"), length=50)


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, the place and the similarity."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, read(spark, sf_dir, "benchmark"), threshold=0.75, width=5)


QUERIES = {
    "op3_repeated_passages": op3_repeated_passages,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
}
ORACLES: dict[str, str] = {}
