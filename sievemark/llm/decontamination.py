"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A window of a document is compared with items of as many words. Only windows that share a shingle with an
item can be similar to it, so windows are taken around shared shingles; that filter loses nothing. The SimHashes of all
windows of one size are compared with the SimHashes of the items of that size block by block: of ``BLOCKS`` blocks
of 32 bits, two fingerprints within ``RADIUS`` are within RADIUS // BLOCKS bits in at least one block, so the blocks
list every item within the radius, and about a tenth of the unrelated ones. Blocks are compared, not looked up: at this
radius blocks of 8 bits, whose near values a table could hold, would list 92 % of the unrelated ones. What is listed and within
the radius is verified by the exact weighted similarity of the two multisets of shingles: the sum of least counts by the
sum of greatest counts.

At similarity 0.75 fingerprints of 128 bits differ in 22 bits on average with deviation about 4.3; the radius of
43 is nearly five deviations away, and unrelated windows differ in 64.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

_U = np.uint64
BITS, BLOCKS, RADIUS = 128, 4, 43
#: Most items of one block of the query set; each block is one broadcast of bounded size.
ITEMS = 20_000
#: About the most bytes of texts in such a block.
ITEM_BYTES = 64 << 20
#: Most windows and items compared at a time.
PAIRS = 1 << 20


def simhash_bits(shingles: np.ndarray) -> np.ndarray:
    """+1/-1 contributions of shingles to the bits of a fingerprint: one row each."""
    two = np.stack([words.mix(shingles ^ _U(0x6A09E667F3BCC909)), words.mix(shingles ^ _U(0xBB67AE8584CAA73B))], axis=1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Packed fingerprints (16 bytes each) of summed contributions."""
    return np.packbits(sums > 0, axis=1)


class Index:
    """Items with their shingles and the multi-index of their fingerprints."""

    def __init__(self, items: list[bytes], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        found, at = words.hashes(items)
        self.n_words = np.diff(at)
        self.shingles = [words.shingles(found[at[k] : at[k + 1]], width) for k in range(len(items))]
        self.counts = [Counter(x.tolist()) for x in self.shingles]
        #: Of each shingle, the sizes in words of the items that hold it.
        self.sizes: dict[int, set[int]] = {}
        for k, c in enumerate(self.counts):
            for s in c:
                self.sizes.setdefault(s, set()).add(int(self.n_words[k]))
        self.keys = np.array(sorted(self.sizes), _U)
        self.widths = sorted({int(n) for n in self.n_words if 0 < n < width})
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(self.keys & _U((1 << 20) - 1)).astype(np.int64)] = True
        prints = [fingerprints(simhash_bits(x).sum(axis=0, dtype=np.int32)[None, :])[0] if len(x) else np.zeros(BITS // 8, np.uint8) for x in self.shingles]
        blocks = np.array(prints, np.uint8).reshape(-1, BITS // 8).view(np.uint32)
        #: By size in words: the items of that size, and their fingerprints' blocks, a row for each block.
        self.of_size = {int(n): (at := np.flatnonzero(self.n_words == n), np.ascontiguousarray(blocks[at].T)) for n in np.unique(self.n_words)}

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints of windows within the radius of an item of ``size`` words."""
        items, blocks = self.of_size[size]
        mine = prints.view(np.uint32).T
        step = max(1, PAIRS // len(items))
        windows, found = [], []
        for first in range(0, mine.shape[1], step):
            far = [np.bitwise_count(mine[b, first : first + step, None] ^ blocks[b][None, :]) for b in range(BLOCKS)]
            listed = far[0] <= RADIUS // BLOCKS
            for x in far[1:]:
                listed |= x <= RADIUS // BLOCKS
            w, k = np.nonzero(listed)
            within = sum(x[w, k].astype(np.int32) for x in far) <= RADIUS
            windows.append(w[within] + first)
            found.append(items[k[within]])
        return np.concatenate(windows), np.concatenate(found)

    def leaks(self, text_words: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, first word, similarity) of the best window of each item that the text holds."""
        anchors: dict[int, set[int]] = {}
        of_width = {}
        for width in [self.width, *self.widths]:
            s = of_width[width] = words.windows(text_words, width)
            at = np.flatnonzero(self.bloom[(s & _U((1 << 20) - 1)).astype(np.int64)])
            for p in at.tolist():
                for n in self.sizes.get(int(s[p]), ()):
                    if min(self.width, n) == width:
                        anchors.setdefault(n, set()).add(p)
        best: dict[int, tuple[float, int]] = {}
        for n, at in anchors.items():
            s = of_width[min(self.width, n)]
            m = n - min(self.width, n) + 1  # shingles of a window
            last = len(s) - m
            if last < 0:
                starts = np.zeros(1, np.int64)
                m = len(s)
            else:
                starts = np.unique(np.clip(np.array(sorted(at))[:, None] - np.arange(m)[None, :], 0, last))
            low = int(starts[0])
            part = s[low : int(starts[-1]) + m]
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(simhash_bits(part), axis=0, dtype=np.int32)])
            prints = fingerprints(sums[starts - low + m] - sums[starts - low])
            windows, items = self.near(prints, n)
            own, before = Counter(), -1
            for w, k in zip(windows.tolist(), items.tolist()):
                start = int(starts[w])
                if w != before:
                    own, before = Counter(s[start : start + m].tolist()), w
                both = sum((own & self.counts[k]).values())
                likeness = both / (own.total() + self.counts[k].total() - both)
                if likeness >= self.threshold and likeness > best.get(k, (0.0, 0))[0]:
                    best[k] = (likeness, start)
        return [(k, start, likeness) for k, (likeness, start) in best.items()]


#: Indexes built in this worker, by the token of their broadcast.
_built: dict[str, Index] = {}


def _index(token: str, items, width: int, threshold: float) -> Index:
    if token not in _built:
        while len(_built) >= 2:
            _built.pop(next(iter(_built)))
        _built[token] = Index(items.value[1], width, threshold)
    return _built[token]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[str, object]]:
    """Broadcasts of the benchmark's ids and texts, at most about ``ITEMS`` items and ``ITEM_BYTES`` bytes each, with a token."""
    spark = benchmark.sparkSession
    slim = benchmark.select("item_id", "text").where("text IS NOT NULL")
    n, size = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    for b in range(blocks):
        own = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        table = own.toArrow().combine_chunks()
        yield uuid.uuid4().hex, spark.sparkContext.broadcast((table.column(0), [t.encode() for t in table.column(1).to_pylist()]))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """doc_id, item_id, first_word, n_words and similarity of each benchmark item that a document holds.

    Of each document and item, the most similar window of as many words as the item (the first of equals; the
    whole text if it is shorter). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; items of fewer than ``width``
    words are one shingle. Null or empty items and texts match nothing; repeated rows give repeated results.
    The benchmark is a query set: it is taken in blocks of at most ``ITEMS`` items, each run against all documents.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, first_word long, n_words long, similarity double"
    found = None
    for token, items in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], token=token, items=items) -> Iterator[pa.RecordBatch]:
            index = _index(token, items, width, threshold)
            for batch in batches:
                rows, what = [], []
                for first, texts in words.chunks(batch.column(1)):
                    every, at = words.hashes(texts)
                    for i in range(len(texts)):
                        for k, start, likeness in index.leaks(every[at[i] : at[i + 1]]):
                            rows.append(first + i)
                            what.append((k, start, int(min(index.n_words[k], at[i + 1] - at[i])), likeness))
                ids = items.value[0].take(pa.array([w[0] for w in what], pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        ids,
                        pa.array([w[1] for w in what], pa.int64()),
                        pa.array([w[2] for w in what], pa.int64()),
                        pa.array([w[3] for w in what], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "first_word", "n_words", "similarity"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    Rows are judged as they pass, so there is no join; all rows of a document that holds an item in one of them go. Rows
    without doc_id are documents of their own.
    """
    kept = docs.columns
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col("text").alias("_text"))
    flags = named.withColumn("_holds", F.lit(False))
    for token, items in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], token=token, items=items) -> Iterator[pa.RecordBatch]:
            index = _index(token, items, width, threshold)
            for batch in batches:
                held = batch.column(batch.num_columns - 1).to_pylist()
                for first, texts in words.chunks(batch.column(batch.num_columns - 2)):
                    every, at = words.hashes(texts)
                    for i in range(len(texts)):
                        held[first + i] = held[first + i] or bool(index.leaks(every[at[i] : at[i + 1]]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, pa.bool_())], schema=batch.schema)

        flags = flags.mapInArrow(run, flags.schema)
    flags = scratch.table(flags.drop("_text"), "judged")
    own = f"c{kept.index('doc_id')}"
    gone = scratch.table(flags.where("_holds").select(F.col(own).alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "holders")
    left = flags.where("NOT _holds").withColumnRenamed(own, "doc_id")
    if not gone.isEmpty():
        left = left.join(F.broadcast(gone) if gone.count() <= scratch.BROADCAST_IDS else gone, "doc_id", "left_anti")
    return left.select(*[F.col("doc_id" if f"c{i}" == own else f"c{i}").alias(c) for i, c in enumerate(kept)])
