"""Queries on shards and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, sharding
from .tables import read


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by histogram sort."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, shards=40).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines counted, dropped where repeated, and a digest of what stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, min_docs=3, min_chars=20).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line[pos] AS line,
         translate(trim(line[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, line, unnest(range(1, len(line) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents))
), common AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NOT NULL AND l.doc_id < c.last AS gone
  FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op1_histogram_shards": op1_histogram_shards, "op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": OP9_SQL}
