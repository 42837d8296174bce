"""Repeated passages by sparse suffixes.

Of each text only the suffixes that start at content-selected positions are kept: the minimisers of every
``WINDOW`` consecutive ``GRAM``-word hashes. A passage of ``length`` words holds, within its first WINDOW
positions, one that is selected wherever the passage stands, and from there on at least ``length`` - WINDOW + 1
of its words follow. So suffixes are grouped by the hash of that many words, without sorting them: those of a group
with two documents are candidates. Each is then extended left and right: every
``length``-word window around it is taken, by its hash, and is repeated if it stands in two documents. What repeated
windows cover, joined, are the passages; that equals a comparison of all windows of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, words

_U = np.uint64
GRAM, WINDOW = 6, 16


def minimisers(found: np.ndarray) -> np.ndarray:
    """Positions whose GRAM-word hash is least (leftmost of equals) in some WINDOW of consecutive ones."""
    grams = words.windows(found, GRAM)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = grams.copy(), np.arange(len(grams))
    span = 1
    while span < WINDOW:  # WINDOW is a power of two
        later = best[span:] < best[:-span]
        best, at = np.where(later, best[span:], best[:-span]), np.where(later, at[span:], at[:-span])
        span *= 2
    return np.unique(at[:n])


def _suffixes(docs: DataFrame, length: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    reach = length - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in words.chunks(batch.column(1)):
                every, at = words.hashes(texts)
                rows, keys, places = [], [], []
                for i in range(len(texts)):
                    own = every[at[i] : at[i + 1]]
                    if len(own) >= length:
                        heads = words.windows(own, reach)
                        p = minimisers(own)
                        p = p[p < len(heads)]
                        rows.append(np.full(len(p), first + i))
                        keys.append(heads[p])
                        places.append(p)
                row = np.concatenate(rows) if rows else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        batch.column(2).take(pa.array(row, pa.int64())),
                        pa.array(words.signed(np.concatenate(keys) if keys else np.empty(0, _U))),
                        pa.array(np.concatenate(places) if places else np.empty(0, np.int64), pa.int64()),
                    ],
                    names=["doc_id", "most", "head", "place"],
                )

    return docs.select("doc_id", "text", "most").mapInArrow(run, f"doc_id {kind}, most {kind}, head long, place long")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """Hashes of the windows around the candidate places: doc_id, most, first, code."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            for first, texts in words.chunks(batch.column(1)):
                every, at = words.hashes(texts)
                rows, starts, codes = [], [], []
                for i in range(len(texts)):
                    own = words.windows(every[at[i] : at[i + 1]], length)
                    p = held[first + i].values.to_numpy(zero_copy_only=False)
                    s = np.unique(p[:, None] - np.arange(WINDOW)[None, :])
                    s = s[(s >= 0) & (s < len(own))]
                    rows.append(np.full(len(s), first + i))
                    starts.append(s)
                    codes.append(own[s])
                row = pa.array(np.concatenate(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(3).take(row), pa.array(np.concatenate(starts), pa.int64()), pa.array(words.signed(np.concatenate(codes)))],
                    names=["doc_id", "most", "first", "code"],
                )

    return docs.select("doc_id", "text", "places", "most").mapInArrow(run, f"doc_id {kind}, most {kind}, first long, code long")


def repeated(docs: DataFrame, length: int = 50) -> DataFrame:
    """Stretches of documents whose every word is in a ``length``-word window that another document also has.

    Returns doc_id, first_word, n_words and least_doc_id, the smallest doc_id that
    holds the stretch's first window or, for texts equal to another whole text, that has an equal text.
    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Documents without such a stretch do not appear, nor do
    null or shorter texts or rows without doc_id. Rows that repeat a doc_id are one document: a passage that
    only they share is not repeated, and their stretches are joined.

    Of texts equal in all bytes that several documents have, one row stands for all: each is repeated as a whole, and its
    windows only tell that other texts' windows are. A document's other rows are compared on their own.
    """
    if length < 2 * WINDOW:
        raise ValueError(f"length must be at least {2 * WINDOW}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    rows = scratch.table(_members(some), "members")
    several = scratch.table(rows.where("least <> most").select("doc_id", "h1", "h2", "least", "most").distinct(), "several")
    small = several.count() <= scratch.BROADCAST_IDS // 4  # of five columns
    keyed = _keyed(some).join(F.broadcast(several) if small else several, ["doc_id", "h1", "h2"], "left")
    one = keyed.where("least IS NULL OR doc_id = least").select("doc_id", "text", F.coalesce("most", "doc_id").alias("most"))
    suffixes = scratch.table(_suffixes(one, length), "suffixes")
    alone = F.bool_or(F.col("doc_id") == F.col("most")).alias("alone")
    heads = suffixes.groupBy("head").agg(F.min("doc_id").alias("d0"), F.max("most").alias("d1"), alone).where("d0 <> d1 AND alone").select("head")
    heads = scratch.table(heads, "heads")  # both sides of the join are then plain shuffles, whose heavy keys Spark can split
    places = scratch.table(suffixes.join(heads, "head").groupBy("doc_id").agg(F.collect_set("place").alias("places")), "places")
    texts = scratch.by_ids(one, places.select("doc_id"), "left_semi")
    windows = scratch.table(_windows(texts.join(places, "doc_id"), length), "windows")
    twice = windows.groupBy("code").agg(F.min("doc_id").alias("least_doc_id"), F.max("most").alias("d1"), alone).where("least_doc_id <> d1 AND alone").drop("d1", "alone")
    twice = scratch.table(twice, "twice")
    marked = windows.where("doc_id = most").join(twice, "code").select("doc_id", "first", "least_doc_id")
    of_doc = marked.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "least_doc_id"))).alias("marks"))
    parts = of_doc.mapInArrow(_merged(length), f"doc_id {kind}, first_word long, n_words long, least_doc_id {kind}")
    whole = rows.where(f"least <> most AND n >= {length}").select("doc_id", F.lit(0).cast("long").alias("first_word"), F.col("n").alias("n_words"), F.col("least").alias("least_doc_id"))
    return _joined(whole.unionByName(parts))


def _joined(stretches: DataFrame) -> DataFrame:
    """Stretches of a document that meet or overlap as one: those of its several rows."""
    order = Window.partitionBy("doc_id").orderBy("first_word", "n_words", "least_doc_id")
    end = F.col("first_word") + F.col("n_words")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = stretches.withColumn("_new", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("long")).withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = begun.groupBy("doc_id", "_stretch").agg(F.min(F.struct("first_word", "least_doc_id")).alias("first"), F.max(end).alias("end"))
    return one.select("doc_id", "first.first_word", (F.col("end") - F.col("first.first_word")).alias("n_words"), "first.least_doc_id")


def _keyed(some: DataFrame) -> DataFrame:
    return some.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.crc32("text"))


def _members(some: DataFrame) -> DataFrame:
    """doc_id, hashes h1 and h2, number of words n and the smallest and largest doc_id of an equal text, for each row."""
    n = F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), "[ \\t-\\r]+")).cast("long")
    keyed = _keyed(some).select("doc_id", "h1", "h2", n.alias("n"))
    same = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return keyed.join(scratch.table(same, "same"), ["h1", "h2"])


def _merged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes, least = [], [], [], []
            for i in range(batch.num_rows):
                marks = batch.column(1)[i].values
                first = marks.field("first").to_numpy(zero_copy_only=False)
                begin = np.flatnonzero(np.concatenate([[True], np.diff(first) > length]))
                end = np.concatenate([begin[1:], [len(first)]]) - 1
                rows.extend([i] * len(begin))
                starts.extend(first[begin].tolist())
                sizes.extend((first[end] - first[begin] + length).tolist())
                least.extend(marks.field("least_doc_id").take(pa.array(begin)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(least, batch.column(0).type)],
                names=["doc_id", "first_word", "n_words", "least_doc_id"],
            )

    return run
