"""Importance resampling towards a target corpus, by hashed runs of words, with long texts cut into overlapping chunks.

A feature is a run of ``width`` consecutive words; its bucket is a hash. How much more often a bucket's features come in
the target than in the documents is its gain, a document's weight is the sum of the gains of its features, and Gumbel
noise from a hash of the doc_id turns the highest weights into a draw without replacement.

Texts beyond ``LONG`` bytes are cut at word boundaries into chunks of their own rows, which Spark deals out like any
others. A chunk owns the words that start in it and carries the next width - 1 words along, so every feature is counted
in the chunk that owns its first word, once. Counts and weights of chunks are summed by document; a document is told
by doc_id and digest of its text, rows that repeat both are counted, not gathered.

Three reads of the texts (cutting, counts, weights); what is shuffled is a row for each document, a few numbers long, and
at most ``buckets`` sums a task. Ranks come from ranges of the score: each range is sorted by one task, counts before it
are added from the totals of the ranges.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Texts of more bytes are cut into chunks of about as many.
LONG = 1 << 16
#: Words after A-Z became lower case: digits, letters and all beyond ASCII, in UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CACHE = 1 << 19
_SCORED = "doc_id {0}, n_words long, n_features long, weight long"
#: Equal rows that one row stands for are written out so many at a time.
_COPIES = 4096


def cut(text: bytes, width: int, long: int = LONG) -> Iterator[tuple[bytes, int]]:
    """The chunks of a text and the number of words that each owns. A word longer than ``long`` makes a longer chunk."""
    found = [m.span() for m in WORD.finditer(text)]
    starts, ends = [a for a, _ in found], [b for _, b in found]
    owned = 0
    while owned < len(starts):
        last = owned + 1
        limit = starts[owned] + long
        while last < len(starts) and ends[last] <= limit:
            last += 1
        carry = min(len(starts), last + width - 1)
        yield text[starts[owned] : ends[carry - 1]], last - owned
        owned = last


class Hashed(dict):
    """Buckets (or their gains) of features, as they are asked for; emptied when it has grown to ``_CACHE`` features."""

    def __init__(self, buckets: int, gains: list[int] | None = None):
        self.buckets, self.gains = buckets, gains

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        k = zlib.crc32(feature) % self.buckets
        self[feature] = k = k if self.gains is None else self.gains[k]
        return k


def features(text: bytes, width: int, owned: int | None = None) -> tuple[list[bytes], int]:
    """The features that start in the owned words (None: in all), and the number of these words."""
    words = WORD.findall(text)
    owned = len(words) if owned is None else owned
    if width == 1:
        return words[:owned], owned
    return [b" ".join(words[i : i + width]) for i in range(min(owned, len(words) - width + 1))], owned


def pieces(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Documents of up to ``LONG`` bytes as they are (doc_id, text), and the chunks of the others in a written table."""
    size, text = F.octet_length("text"), F.col("text")
    short = docs.where(size.isNull() | (size <= LONG)).select("doc_id", text.cast("binary").alias("text"))
    long = docs.where(size > LONG).select("doc_id", F.md5(text.cast("binary")).alias("digest"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, size, n = [], 0, 0
                for piece, owned in cut(batch["text"][i].as_py().lower(), width) or [(b"", 0)]:
                    out.append((piece, owned, n))
                    size, n = size + len(piece), n + 1
                    if size > 16 * LONG:
                        yield made(batch, i, out)
                        out, size = [], 0
                if out or not n:
                    yield made(batch, i, out or [(b"", 0, 0)])

    def made(batch: pa.RecordBatch, i: int, out: list) -> pa.RecordBatch:
        head = [batch[c].slice(i, 1).take(pa.array([0] * len(out))) for c in ("doc_id", "digest")]
        texts, owned, n = zip(*out)
        names = ["doc_id", "digest", "text", "owned", "piece"]
        return pa.RecordBatch.from_arrays([*head, pa.array(texts, pa.binary()), pa.array(owned, pa.int64()), pa.array(n, pa.int64())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return short, scratch.table(long.mapInArrow(run, f"doc_id {kind}, digest string, text binary, owned long, piece long"), "pieces")


def counts(short: DataFrame, long: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Hashed(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            found: Counter = Counter()
            owned = batch["owned"].to_pylist()
            for i, text in enumerate(batch["text"]):
                found.update(features((text.as_py() or b"").lower(), width, owned[i])[0])
                if len(found) > _CACHE or i + 1 == batch.num_rows:
                    for feature, n in found.items():
                        total[hashed[feature]] += n
                    found.clear()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    texts = short.select("text", F.lit(None).cast("long").alias("owned")).unionByName(long.select("text", "owned"))
    sums = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # ``buckets`` rows at most
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each of B buckets, in doubles."""
    b, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log(((t + 1.0) * (all_s + b)) / ((s + 1.0) * (all_t + b)))) for s, t in zip(source.tolist(), target.tolist())]


def weights(short: DataFrame, long: DataFrame, width: int, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight, copies: a row for every distinct one of these, with the number of documents."""
    kind = short.schema["doc_id"].dataType.simpleString()
    sent = short.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(len(sent.value), sent.value)
        for batch in batches:
            owned = batch["owned"].to_pylist() if "owned" in batch.schema.names else [None] * batch.num_rows
            sums = []
            for text, own in zip(batch["text"], owned):
                found, n = features((text.as_py() or b"").lower(), width, own)
                sums.append((n, len(found), sum(map(hashed.__getitem__, found))))
            head = [c for c in batch.schema.names if c not in ("text", "owned")]
            columns = [pa.array(c, pa.int64()) for c in zip(*sums)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in head), *columns], [*head, "n_words", "n_features", "weight"])

    one = short.mapInArrow(run, _SCORED.format(kind)).withColumn("copies", F.lit(1).cast("long"))
    many = long.select("doc_id", "digest", "piece", "text", "owned").mapInArrow(run, _SCORED.format(f"{kind}, digest string, piece long"))
    copies = F.sum((F.col("piece") == 0).cast("long"))
    many = many.groupBy("doc_id", "digest").agg(*((F.sum(c) / copies).cast("long").alias(c) for c in ("n_words", "n_features", "weight")), copies.alias("copies"))
    both = one.unionByName(many.drop("digest"))
    return both.groupBy("doc_id", "n_words", "n_features", "weight").agg(F.sum("copies").alias("copies"))


def noise(doc_id, seed: int):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:doc_id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def placed(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (written; score, doc_id, n_features, weight, copies) with ``before``: copies that come before each."""
    order = (F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch["copies"].to_numpy()) + so_far
            if len(sums):
                before = sums - batch["copies"].to_numpy()
                so_far = int(sums[-1])
                extra = [pa.array(np.full(len(sums), part, np.int64)), pa.array(before)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "before"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part long, before long"
    sorted_ = scratch.table(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranges")
    totals = sorted_.groupBy("part").agg(F.sum("copies").alias("n")).orderBy("part").collect()  # one row for each range
    firsts, n = [], 0
    for t in totals:
        firsts.append((t["part"], n))
        n += t["n"]
    offsets = rows.sparkSession.createDataFrame(firsts, "part long, first long")
    return sorted_.join(F.broadcast(offsets), "part").withColumn("before", F.col("before") + F.col("first")).drop("part", "first")


def resample(
    docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """Every document's weight, score and, where it is drawn, rank.

    ``docs`` has doc_id and text, ``target`` text; other columns are left aside, whatever their names. A null or empty
    text has no features and weight 0; a text of fewer words than ``width`` has none either. Of the N documents with at
    least ``least_words`` words, floor(percent * N / 100) are drawn: highest scores, ties to smaller doc_id (null
    first), then to fewer features, then to less weight; rows equal in all of these share out consecutive ranks. A null
    doc_id has the noise of an empty name. No documents give no rows; an empty target counts nothing.

    Returns one row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null: not drawn).
    """
    short, long = pieces(docs.select("doc_id", "text"), width)
    wanted = pieces(target.select(F.lit(0).alias("doc_id"), "text"), width)
    gain = gains(counts(short, long, width, buckets), counts(*wanted, width, buckets))
    scratch.drop(wanted[1])
    rows = weights(short, long, width, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = scratch.table(rows, "weights")
    scratch.drop(long)
    long_enough = F.col("n_words") >= least_words
    n, each, most = rows.agg(F.sum(F.when(long_enough, F.col("copies"))), F.count(F.when(long_enough, 1)), F.max("copies")).first()
    drawn = percent * (n or 0) // 100
    ranked = placed(rows.where(long_enough), scratch.parts_for(rows.sparkSession, 64 * each))
    out = ranked.unionByName(rows.where(~long_enough).withColumn("before", F.lit(None).cast("long")))
    out = out.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_COPIES).cast("long"))))
    if (most or 0) > _COPIES:
        out = out.repartition(scratch.shuffle_partitions(rows.sparkSession))
    last = F.least(F.col("copies"), F.col("at") + _COPIES) - 1
    out = out.withColumn("copy", F.explode(F.sequence("at", last))).withColumn("rank", F.col("before") + F.col("copy") + 1)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def drawn(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The drawn documents with all their columns and their rank, for documents of distinct ids."""
    ranks = found.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn_id"), F.col("rank").alias("_drawn_rank"))
    return docs.join(ranks, docs["doc_id"] == ranks["_drawn_id"]).drop("_drawn_id")
