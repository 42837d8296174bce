"""Queries on nearest vectors and on samples towards a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, impact_search, resampling, vectors
from .tables import read


def op11_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth, by integer inner product."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", vectors.quantised(F.col("embedding")).alias("vec"))
    found = impact_search.top_k(rows, F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", "vec_id", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of the five positives of every hundredth vector; each seventh has the next label."""
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), vectors.quantised(F.col("embedding")).alias("vec"))
    found = hard_negatives.mine(rows, vec_id % 100 == 0, positives=5, negatives=10, low=30, high=90)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn by how much their words resemble the benchmark's."""
    docs, target = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text")
    found = resampling.resample(docs, target, width=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_VECTORS = """
WITH v AS (
  SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

OP11_SQL = (
    _VECTORS.format(label="label")
    + """, scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
)

OP12_SQL = (
    _VECTORS.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    + """, scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, list_inner_product(a.vec, r.vec)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
  WHERE a.label IS NOT NULL AND r.label IS NOT NULL
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negative AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
  WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10
"""
)

OP13_SQL = r"""
WITH RECURSIVE crc(i, n, step) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN n & 1 = 1 THEN xor(n >> 1, 3988292384) ELSE n >> 1 END, step + 1 FROM crc WHERE step < 8
), steps AS (
  SELECT list(n ORDER BY i) AS t FROM crc WHERE step = 8
), docs AS (
  SELECT row_number() OVER () AS id, doc_id, text FROM documents
), doc_words AS (
  SELECT id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM docs
), per_doc AS (
  SELECT id, word, count(*) AS n FROM doc_words GROUP BY ALL
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), bytes AS (
  SELECT word, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT) AS b
  FROM (SELECT word FROM per_doc UNION SELECT word FROM target_words)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, steps
), source AS (
  SELECT bucket, sum(n)::DOUBLE AS s FROM per_doc JOIN hashed USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*)::DOUBLE AS t FROM target_words JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce((SELECT sum(s) FROM source), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM target), 0)::DOUBLE AS all_t
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000)) / ((coalesce(s, 0) + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM source FULL JOIN target USING (bucket), totals
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM per_doc JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT id, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (id)
), ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (id)
"""

QUERIES = {"op11_impact_top_k": op11_impact_top_k, "op12_hard_negatives": op12_hard_negatives, "op13_target_resampling": op13_target_resampling}
ORACLES = {"op11_impact_top_k": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_target_resampling": OP13_SQL}
