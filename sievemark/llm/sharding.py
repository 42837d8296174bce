"""Sharding by histogram sort: splitters from exact counts, then one exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, splitters


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, overhead: int = 16) -> DataFrame:
    """``docs`` (doc_id, text, any others) with size, shard and slot; shards have near equal sums of size.

    size: UTF-8 bytes of the text (null: none) plus ``overhead``. Rows are sorted by a hash of the text, so that
    equal texts lie together, and within it by a hash of doc_id, so that a group of copies heavier than a
    shard is cut between shards. Rows equal in text and doc_id can't be told apart and stay together; null
    texts are one group, null doc_ids one key. slot counts from 0 without gaps in each shard. An empty
    table gives an empty result; existing columns named size, shard or slot are replaced.

    Shards are cut into parts of bounded bytes, and slots are numbered in parts, from the exact number of rows before
    each: no task holds a whole shard when there are more machines than shards.
    """
    spark = docs.sparkSession
    rows, named = scratch.apart(docs, "doc_id", "text", without=("size", "shard", "slot"))
    keyed = rows.select(
        "*",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.xxhash64("text").alias("k1"),
        F.xxhash64("doc_id").alias("k2"),
    )
    keys = scratch.table(keyed.select("k1", "k2", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-scratch.parts_for(spark, total) // shards))
    cut = splitters.find(keys, shards * each, tolerance / each)
    before = cut.rows_before + [cut.total_rows] * (shards * each - len(cut.rows_before))
    offsets = F.array(*[F.lit(before[p] - before[p - p % each]).cast("long") for p in range(shards * each)])
    within = Window.partitionBy("_part").orderBy("k1", "k2", "doc_id")
    return named(
        cut.part(keyed, "k1", "k2", "_part")
        .repartition(shards * each, "_part")
        .withColumn("_row", F.row_number().over(within).cast("long") - 1)
        .select(
            *rows.columns,
            "size",
            F.floor(F.col("_part") / each).cast("int").alias("shard"),
            (F.col("_row") + F.element_at(offsets, F.col("_part") + 1)).alias("slot"),
        )
    )


def write(sharded: DataFrame, path: str) -> None:
    """The shards as folders of Parquet files, ``shard=0`` and so on."""
    sharded.write.partitionBy("shard").parquet(path)
