"""Query on fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import winnowing
from .tables import read


def op10_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness to each other and to the next one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = winnowing.with_fingerprint(docs, "text", "print")
    paired = winnowing.with_next(printed, ["text", "print"])
    changed = paired.withColumn("edited", winnowing.edited(F.col("text"), F.col("next_text"))).drop("next_text")
    both = winnowing.with_fingerprint(changed, "edited", "edited_print")
    hashed = both.select("*", *[winnowing.hashes(F.col(c)).alias(f"{c}_set") for c in ("print", "edited_print", "next_print")])
    return hashed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.as_text(F.col("print")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("print_set"), F.col("edited_print_set")).alias("near_edited"),
        winnowing.likeness(F.col("print_set"), F.col("next_print_set")).alias("near_next"),
    )


QUERIES = {"op10_winnowing_fingerprints": op10_winnowing_fingerprints}
ORACLES: dict[str, str] = {}
