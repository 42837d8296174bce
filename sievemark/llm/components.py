"""Connected components by alternating large-star and small-star steps; only aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node (``root``) of each ``node`` in ``links`` (a, b; any orderable type, undirected).

    Only nodes with a link to another node appear. A round moves a few times the links; least neighbours are partial
    minima, written before they are joined, so that both sides of a join are plain shuffles whose heavy nodes Spark
    can split. Links and nodes stay in tables throughout.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.table(edges, "cc")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = scratch.table(large, "cc-large")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        now = scratch.table(after, "cc")
        for t in (edges, least, large, low):
            scratch.drop(t)
        edges = now
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select("v", "v").distinct())
