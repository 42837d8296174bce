"""Hard negatives by product quantisation with stored residual norms: bounds filter, exact integers decide.

Vectors are cut into parts of two components; each part has a codebook of up to 256 centres (k-means on a bounded
sample: ``SAMPLE`` rows of least hash). Every row, in the sample or not, is indexed: a byte for each part and the norm of
what the centres leave over. For an anchor, a table of its products with all centres gives every row's score by looking
up and adding, and by Cauchy and Schwarz the true score is within |anchor| * residual of it. These bounds only rule out
rows that cannot belong to the result; all others are scored again with exact integers, so recall is 1 at any sample.

Pass one finds each anchor's positives, pass two, with the windows that the positives' scores give, the negatives.
Tasks go over blocks of 8,192 rows on their own and hand on ``k`` rows for an anchor or a window; anchors are sent to the
tasks in chunks of bounded bytes. No group of a label or an id is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, vectors

#: Components of a part, centres of its codebook, rows that codebooks are learned from, rounds of k-means.
PART, CENTRES, SAMPLE, ROUNDS = 2, 256, 8192, 8
INDEX = "ids binary, rows binary, labels binary, vec binary, kind string, width long, codes binary, rest binary"
POSITIVES = "anchor_row long, anchor_id long, positive_score long, positive_id long, positive_row long"
NEGATIVES = "anchor_row long, positive_score long, negative_score long, negative_id long, negative_row long"


def codebooks(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Centres by part: parts x CENTRES x PART. One task learns one part's at a time; the sample is a few MB at most."""
    spark = rows.sparkSession
    picked = rows.select("vec", F.xxhash64("row").alias("h")).orderBy("h").limit(sample).select("vec").toArrow()
    vec = _parts(vectors.matrix(picked["vec"].combine_chunks()).astype(np.float64))
    if not vec.size:
        return np.zeros((0, 1, PART))
    sent = spark.sparkContext.broadcast(vec)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch["id"].to_pylist():
                yield pa.RecordBatch.from_pylist([{"part": part, "centres": _means(sent.value[:, part]).ravel().tolist()}])

    n = vec.shape[1]
    got = spark.range(0, n, 1, n).mapInArrow(learn, "part long, centres array<double>").collect()  # a few KB a part
    return np.array([r["centres"] for r in sorted(got)]).reshape(n, -1, PART)


def _parts(vec: np.ndarray) -> np.ndarray:
    """rows x parts x PART; the last part is filled up with zeros."""
    n = -(-vec.shape[1] // PART)
    return vectors.widened(vec, n * PART).reshape(len(vec), n, PART)


def _means(points: np.ndarray) -> np.ndarray:
    """CENTRES centres by k-means, started from points spread over the order of their first component."""
    order = np.lexsort(points.T[::-1])
    centres = points[order[(np.arange(CENTRES) * 2 + 1) * len(points) // (2 * CENTRES)]]
    for _ in range(ROUNDS):
        near = _nearest(points, centres)
        counts = np.bincount(near, minlength=CENTRES)
        sums = np.stack([np.bincount(near, weights=points[:, d], minlength=CENTRES) for d in range(PART)], 1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    scale = max(1.0, float(np.abs(points).max(initial=0)), float(np.abs(centres).max(initial=0)))
    p, c = points / scale, centres / scale
    return np.argmin(np.square(c).sum(1) - 2 * p @ c.T, axis=1)


def index(rows: DataFrame, books: np.ndarray, block: int = vectors.BLOCK) -> DataFrame:
    """Codes and residual norms of all numbered rows (row, vec_id, label, vec), one row for each block, in a written table."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    build = lambda t: _block(t, sent.value)
    return scratch.table(vectors.blocks(rows.select("row", "vec_id", "label", "vec"), build, INDEX, block), "codes")


def _block(t: pa.Table, books: np.ndarray) -> dict:
    vec = vectors.widened(vectors.matrix(t["vec"].combine_chunks()), len(books) * PART)
    parts = _parts(vec.astype(np.float64))
    codes = np.zeros((parts.shape[1], len(vec)), np.uint8)
    rest = np.zeros(len(vec))
    for p in range(parts.shape[1]):
        points = parts[:, p]
        if p < len(books):  # what no sampled vector had has no centre: it is all left over
            codes[p] = _nearest(points, books[p])
            points = points - books[p][codes[p]]
        rest += np.square(points).sum(1)
    data, kind = vectors.packed(vec)
    return {
        "ids": t["vec_id"].to_numpy().astype("<i8").tobytes(),
        "rows": t["row"].to_numpy().astype("<i8").tobytes(),
        "labels": t["label"].to_numpy().astype("<i8").tobytes(),
        "vec": data,
        "kind": kind,
        "width": vec.shape[1],
        "codes": codes.tobytes(),
        "rest": np.sqrt(rest).astype("<f8").tobytes(),
    }


class Block:
    """A block's codes while a task works on it."""

    def __init__(self, x: dict, books: np.ndarray):
        self.ids, self.rows, self.labels = (np.frombuffer(x[c], "<i8") for c in ("ids", "rows", "labels"))
        n = len(self.ids)
        self.vec = np.frombuffer(x["vec"], x["kind"]).reshape(n, x["width"])
        self.codes = np.frombuffer(x["codes"], np.uint8).reshape(-1, n)
        self.rest = np.frombuffer(x["rest"], "<f8")
        self.books = books
        self.by_label = {int(v): np.flatnonzero(self.labels == v) for v in np.unique(self.labels)}

    def bounds(self, anchor: np.ndarray, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each of ``rows`` (None: all) can have."""
        a = vectors.widened(anchor[None].astype(np.float64), len(self.books) * PART)[0]
        tables = np.einsum("pcd,pd->pc", self.books, a[: len(self.books) * PART].reshape(-1, PART))
        codes, rest = (self.codes, self.rest) if rows is None else (self.codes[:, rows], self.rest[rows])
        about = np.zeros(len(rest))
        for p in range(len(self.books)):
            about += tables[p][codes[p]]
        size = float(np.sqrt(np.square(a).sum()))
        off = size * rest + 1 + 1e-9 * (np.abs(tables).max(1, initial=0).sum() + size * rest)  # and the rounding
        return about - off, about + off


def _kth(x: np.ndarray, k: int) -> float:
    """The ``k``-th greatest."""
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


def _positives(block: Block, anchor: np.ndarray, own: int, label: int, best: vectors.Best) -> None:
    rows = block.by_label.get(label)
    if rows is None or not len(rows := rows[block.rows[rows] != own]):
        return
    low, high = block.bounds(anchor, rows)
    rows = rows[high >= max(best.least, _kth(low, best.k))]
    best.add(vectors.products(block.vec[rows], anchor), block.ids[rows], block.rows[rows])


def _negatives(block: Block, anchor: np.ndarray, label: int, windows: dict[int, vectors.Best], low: int, high: int) -> None:
    least, most = block.bounds(anchor, None)
    other = block.labels != label
    scores: dict[int, int] = {}
    for positive, best in windows.items():
        inside = other & (100 * least >= low * positive) & (100 * most <= high * positive)  # certain members
        need = max(best.least, _kth(least[inside], best.k))
        rows = np.flatnonzero(other & (100 * most >= low * positive) & (100 * least <= high * positive) & (most >= need))
        if new := [r for r in rows.tolist() if r not in scores]:
            scores |= zip(new, vectors.products(block.vec[new], anchor).tolist())
        exact = [(r, s) for r in rows.tolist() if low * positive <= 100 * (s := scores[r]) <= high * positive]
        keep = np.array([r for r, _ in exact], np.intp)
        best.add(np.array([s for _, s in exact], np.int64), block.ids[keep], block.rows[keep])


def _records(columns: list[str], out: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(out), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + (1 << 16)])], columns)


def _blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[Block]:
    for batch in batches:
        for x in range(batch.num_rows):
            yield Block(batch.slice(x, 1).to_pylist()[0], books)


def _first_pass(indexed: DataFrame, books: np.ndarray, chunk: vectors.Chunk, k: int) -> DataFrame:
    sent = indexed.sparkSession.sparkContext.broadcast((chunk, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, books = sent.value
        best = [vectors.Best(k) for _ in anchors.row]
        for block in _blocks(batches, books):
            for i, label in enumerate(anchors.more["label"]):
                _positives(block, anchors.vec[i], anchors.row[i], label, best[i])
        out = [(int(anchors.row[i]), int(anchors.vec_id[i]), *found) for i, b in enumerate(best) for found in b.rows()]
        yield from _records([c.split()[0] for c in POSITIVES.split(", ")], out)

    return indexed.mapInArrow(run, POSITIVES)


def _second_pass(indexed: DataFrame, books: np.ndarray, chunk: vectors.Chunk, k: int, low: int, high: int) -> DataFrame:
    sent = indexed.sparkSession.sparkContext.broadcast((chunk, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, books = sent.value
        windows = [{p: vectors.Best(k) for p in sorted(set(scores))} for scores in anchors.more["scores"]]
        for block in _blocks(batches, books):
            for i, label in enumerate(anchors.more["label"]):
                _negatives(block, anchors.vec[i], label, windows[i], low, high)
        out = [(int(anchors.row[i]), p, *found) for i, w in enumerate(windows) for p, b in w.items() for found in b.rows()]
        yield from _records([c.split()[0] for c in NEGATIVES.split(", ")], out)

    return indexed.mapInArrow(run, NEGATIVES)


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = vectors.BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """Hard negatives for every row of ``df`` (vec_id, label, vec) that ``is_anchor`` holds for.

    An anchor's positives are its ``positives`` best other rows of its label; for each of them, the negatives are the
    first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Higher scores come first, ties by smaller vec_id, then by row number. ``vec`` holds integers
    (:func:`vectors.quantised`), ``label`` a whole number; rows where either is null take no part. Rows that repeat an id
    are rows of their own. An anchor without positives, and a window without rows (any with a negative positive_score),
    give nothing; an empty table gives none.

    Returns anchor_id, positive_id, rank (from 1, within anchor and positive), negative_id, positive_score,
    negative_score, anchor_row, positive_row, negative_row.
    """
    whole = df.where(F.col("vec").isNotNull() & F.col("label").isNotNull())
    rows = vectors.numbered(whole.select("vec_id", F.col("label").cast("long").alias("label"), "vec"), "labelled", block)
    spark, width = rows.sparkSession, vectors.widest(rows)
    books = codebooks(rows, sample)
    indexed = index(rows, books, block)
    anchors = rows.where(is_anchor)
    firsts = (_first_pass(indexed, books, c, positives) for c in vectors.chunks(anchors, width, ("label",)))
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    found = scratch.union(spark, firsts, POSITIVES, "near").withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    pairs = scratch.table(found.drop("n"), "positives")
    scores = pairs.groupBy("anchor_row").agg(F.collect_set("positive_score").alias("scores"))  # ``positives`` at most
    asked = scratch.table(anchors.join(scores.withColumnRenamed("anchor_row", "row"), "row"), "anchors")
    seconds = (_second_pass(indexed, books, c, negatives, low, high) for c in vectors.chunks(asked, width, ("label", "scores")))
    order = Window.partitionBy("anchor_row", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    far = scratch.union(spark, seconds, NEGATIVES, "far")
    for done in (indexed, rows, asked):
        scratch.drop(done)
    inside = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_row", "positive_row", "negative_row")
    return pairs.join(inside, ["anchor_row", "positive_score"]).select(*columns)
