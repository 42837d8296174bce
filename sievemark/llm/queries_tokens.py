"""Queries on tokens: counts and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, scratch, token_counts
from .tables import read


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every whole document by the byte-level vocabulary, and whether it exceeds 512."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, _path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of at most 4096 tokens."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, _path("word_bpe_49k.json"), capacity=4096, end_id=1)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(scratch.table(digests, "pieces"), capacity=4096)


QUERIES = {"op2_token_counts": op2_token_counts, "op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
