"""Operators on vectors and on samples towards a target, against brute force, with ties, repeats, nulls and odd values."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.llm import hard_negatives, impact_search, queries_search, resampling, vectors

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(np.float32(x))) for x in v]


@pytest.fixture(scope="module")
def rows():
    """400 vectors: random, copies of one, equal ids, nulls, non-finite components, zeros, other lengths, large values."""
    rng = random.Random(5)
    made = [[rng.gauss(0, 0.2) for _ in range(12)] for _ in range(250)]
    out = [(i, v, i % 4) for i, v in enumerate(made)]
    out += [(1000 + i, made[20], i % 4) for i in range(100)]  # a hot vector: a quarter of the rows
    out += [(50, made[7], 1)] * 5  # equal rows
    out += [(2000, None, 1), (2050, [0.5, None], 1), (2100, [NAN] * 12, 2), (2150, [INF] + [0.0] * 11, 2), (2200, [0.0] * 12, 0), (2250, [], 0), (2300, [0.25] * 3, None)]
    out += [(2400 + i, [1.0 + i] * 15, 3) for i in range(10)]
    out += [(2500, [3e4] * 12, 2), (2550, [-3e4] * 12, 1)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    return df.select("vec_id", "label", vectors.quantised(F.col("embedding")).alias("vec"), F.lit("old").alias("row"), F.lit("old").alias("score")).cache()


def test_quantised_floors_and_leaves_out(table, rows):
    got = sorted(((r.vec_id, r.vec) for r in table.collect()), key=repr)
    assert got == sorted(((i, whole(v)) for i, v, _ in rows), key=repr)


@pytest.mark.parametrize("block", [64, 8192])
def test_top_k_equals_brute_force(table, rows, block):
    got = {}
    for r in impact_search.top_k(table, F.col("vec_id") % 50 == 0, k=5, block=block).collect():
        got.setdefault((r.query_id, r.query_row), []).append((r.rank, r.vec_id, r.score, r.found_row))
    part = [(n, i, v) for n, (i, x, _) in enumerate(rows) if (v := whole(x)) is not None]
    want = []
    for n, i, v in part:
        if i % 50 == 0:
            best = sorted((-dot(v, w), j) for m, j, w in part if m != n)[:5]
            want.append((i, [(k, j, -s) for k, (s, j) in enumerate(best, 1)]))
    assert sorted((i, [x[:3] for x in sorted(found)]) for (i, _), found in got.items()) == sorted(want)
    assert all(row not in {x[3] for x in found} for (_, row), found in got.items())


def test_top_k_of_few_rows_and_none(spark, table):
    few = table.where("vec_id IN (0, 1, 2)")
    assert [(r.rank, r.vec_id) for r in impact_search.top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()] in ([(1, 1), (2, 2)], [(1, 2), (2, 1)])
    assert impact_search.top_k(table.where("false"), F.lit(True)).collect() == []
    assert impact_search.top_k(table.where("vec_id = 3"), F.lit(True)).collect() == []


def test_search_stops_before_the_end_only_on_proof():
    """Clustered vectors let most postings be skipped; the result stays that of scoring all."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (40, 32))
    vec = (centres[rng.integers(0, 40, 4096)] + rng.normal(0, 10, (4096, 32))).astype(np.int64)



    t = pa.table({"row": np.arange(4096), "vec_id": np.arange(4096), "vec": pa.array(vec.tolist(), pa.list_(pa.int64()))})
    block, taken = impact_search.Block(impact_search._block(t)), 0
    for q in range(0, 4096, 256):
        best = vectors.Best(5)
        taken += block.search(vec[q], q, best)
        scores = vec @ vec[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert [(s, i) for s, i, _ in best.rows()] == [(-s, i) for s, i in want]
    assert taken < 0.6 * 16 * 4096 * 32


def test_scores_beyond_exact_doubles():
    a = np.array([[1 << 40, 3], [-(1 << 62), 1]], np.int64)
    assert vectors.products(a, np.array([1 << 20, 1])).tolist() == [(1 << 60) + 3, -(1 << 63)]
    best = vectors.Best(2)
    best.add(np.array([-(1 << 63), 5, (1 << 63) - 1]), np.array([1, 2, 3]), np.array([1, 2, 3]))
    assert [s for s, _, _ in best.rows()] == [(1 << 63) - 1, 5]


def negatives_of(rows, low, high):
    part = [(n, i, w, label) for n, (i, v, label) in enumerate(rows) if (w := whole(v)) is not None and label is not None]
    want = []
    for n, i, v, label in part:
        if i % 100 == 0:
            same = sorted((-dot(v, w), j, m) for m, j, w, x in part if m != n and x == label)[:5]
            other = sorted((-dot(v, w), j) for m, j, w, x in part if x != label)
            for p, j, _ in same:
                inside = [(s, k) for s, k in other if low * -p <= 100 * -s <= high * -p][:10]
                want += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(inside, 1)]
    return sorted(want)


@pytest.mark.parametrize("block,sample", [(64, 100), (8192, 8192)])
def test_hard_negatives_equal_brute_force(table, rows, block, sample):
    got = hard_negatives.mine(table, F.col("vec_id") % 100 == 0, block=block, sample=sample).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == negatives_of(rows, 30, 90)


def test_hard_negatives_without_rows_or_labels(spark, table):
    assert hard_negatives.mine(table.where("false"), F.lit(True)).collect() == []
    assert hard_negatives.mine(table.withColumn("label", F.lit(None).cast("int")), F.lit(True)).collect() == []
    assert hard_negatives.mine(table.where("label = 1"), F.lit(True)).collect() == []


def test_bounds_hold_and_rule_most_rows_out():
    rng = np.random.default_rng(4)
    vec = rng.normal(0, 32, (4096, 64)).astype(np.int64)
    parts = hard_negatives._parts(vec.astype(float))
    books = np.stack([hard_negatives._means(parts[:2000, p]) for p in range(parts.shape[1])])

    t = pa.table({"row": np.arange(4096), "vec_id": np.arange(4096), "label": np.zeros(4096, np.int64), "vec": pa.array(vec.tolist(), pa.list_(pa.int64()))})
    block = hard_negatives.Block(hard_negatives._block(t, books), books)
    for q in vec[::500]:
        low, high = block.bounds(q, None)
        exact = vec @ q
        assert (low <= exact).all() and (exact <= high).all()
        assert (high >= np.sort(low)[-10]).mean() < 0.25


# --- resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def grams(t, n):
    w = WORD.findall(lower(t))
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)], len(w)


def resampled(docs, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, n)[0])
    t = Counter(bucket(g) for x in target for g in grams(x, n)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, text in docs:
        found, words = grams(text, n)
        weight = sum(gain(bucket(g)) for g in found)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, words, len(found), weight, score))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = percent * len(order) // 100
    rest = Counter(order[drawn:]) + Counter(r for r in rows if r[1] < least)
    return sorted([(*r, k) for k, r in enumerate(order[:drawn], 1)] + [(*r, None) for r in rest.elements()], key=repr)


@pytest.mark.parametrize("width,long", [(1, 200), (3, 200), (3, 1 << 16)])
def test_resampling_equals_brute_force(spark, texts, monkeypatch, width, long):
    monkeypatch.setattr(resampling, "LONG", long)
    docs = [*texts, *[(200, texts[0][1])] * 9, *[(None, texts[1][1])] * 3, (201, "w" * 5000), (202, "A1-b2_C3 é" * 400), (203, "one two")]
    target = [texts[2][1], None, "", "Word word WORD one-two three"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    df = df.select("*", *[F.lit("old").alias(c) for c in ("weight", "rank", "copies", "digest", "part")])
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(df, wanted, width=width, percent=30, least_words=10)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got.collect()), key=repr) == resampled(docs, target, width, percent=30, least=10)
    assert resampling.drawn(df, got).where("doc_id < 200").select("doc_id").distinct().count() == got.where("rank IS NOT NULL AND doc_id < 200").select("doc_id").distinct().count()


def test_resampling_shares_ranks_among_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_COPIES", 16)
    monkeypatch.setattr(resampling, "LONG", 64)
    docs = [(7, "some words here " * 10)] * 100 + [(i, f"text {i} of its own " * 5) for i in range(50)] + [(7, "some words here " * 10 + "x")] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = resampling.resample(df, df.where("doc_id = 7"), percent=90).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got), key=repr) == resampled(docs, [t for d, t in docs if d == 7], percent=90)
    assert resampling.resample(df.where("false"), df).collect() == []


def test_chunks_own_every_word_once():
    rng = random.Random(9)
    text = " ".join("x" * rng.choice([1, 2, 3, 50, 400]) for _ in range(500)).encode()
    for width in (1, 2, 5):
        for long in (1, 30, 1000, 10**6):
            found = [g for piece, own in resampling.cut(text, width, long) for g in resampling.features(piece, width, own)[0]]
            assert found == resampling.features(text, width)[0]


@pytest.mark.parametrize("name", sorted(queries_search.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries_search.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries_search.ORACLES[name])
    assert sorted(want.columns) == columns
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)
