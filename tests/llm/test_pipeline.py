"""Each stage of the pipeline on what the one before it kept, against brute force."""

import hashlib
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sievemark.llm import packing, quality, scratch
from sievemark.llm.queries_models import held_out_quality

from .test_edges import brute_groups, brute_lines, words_of

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(scratch.table(stage(spark, kept[-1], SF), "test-" + name.replace(" ", "-")))
    assert len(names) == 5 and all(k.columns == docs.columns for k in kept[1:-1])
    start, good, lines, near, clean, packed = kept

    scores = {r.doc_id: r.score for r in quality.scored(start, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out_quality()).collect()}
    assert {d for d, _ in texts_of(good)} == {d for d, s in scores.items() if s >= 0.7}

    want = {(d, h) for d, _, _, h in brute_lines(texts_of(good))}
    assert {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in texts_of(lines)} == want
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0

    assert sorted(d for d, _ in texts_of(near)) == sorted(d for d, _, _, k in brute_groups(texts_of(lines)) if k)

    def bag(w):
        return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])

    items = [(words_of(r.text), bag(words_of(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(t):
        w = words_of(t)
        own = set(bag(w))
        for b, c in items:
            if own & set(c):
                for k in range(max(1, len(w) - len(b) + 1)):
                    x = bag(w[k : k + len(b)])
                    if sum((x & c).values()) >= 0.75 * sum((x | c).values()):
                        return True
        return False

    assert sorted(d for d, _ in texts_of(clean)) == sorted(d for d, t in texts_of(near) if not leaks(t))

    from public_tokenizers import path

    encode = packing.Encoder(path("word_bpe_49k.json"))
    pieces = set()
    for d, t in texts_of(clean):
        ids = encode(t or "") + np.array([1], "<u4").tobytes()
        pieces |= {(d, k // 16384, len(ids[k : k + 16384]) // 4, crc32(ids[k : k + 16384])) for k in range(0, len(ids), 16384)}
    rows = packed.collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096
