"""Exact top-k inner products by an impact-ordered index, score at a time.

Every block of vectors has an index: for each dimension the postings (rows of the block) sorted by their component and
cut into segments of near values, each with its least and greatest value. For a query q and any scale w > 0

    q . v  =  (w |q|^2 + |v|^2 / w) / 2  -  sum over dimensions of (sqrt(w) q_d - v_d / sqrt(w))^2 / 2,

so each row starts at a cap, and every posting can only take something off it. What a segment takes off all its rows
for sure, by its own ends, is its impact for the query. Segments are processed by descending impact, all dimensions
together, and what is left of the caps bounds the scores at any time. Processing stops only when the rows whose bound
still reaches the k-th best exact score are few, or at the end of the segments; these possible members are all scored
again with exact integers. So the result is exact wherever processing stops.

Tasks go over blocks on their own, whatever the number of blocks, and hand on k rows a query; the best of these are
taken by query. Queries are sent to the tasks in chunks of bounded bytes, each a pass over the index. An index holds one
block (8,192 rows) at a time; nothing grows with the number of rows in one key, and equal vectors are only ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, vectors

#: Most segments of a dimension, and rows that a segment has at least.
SEGMENTS, SEGMENT_ROWS = 24, 32
#: Processing looks for its stop after each such share of the segments.
_LOOKS = 16
INDEX = "ids binary, rows binary, vec binary, kind string, width long, members binary, segments binary"
FOUND = "query_row long, query_id long, vec_id long, score long, found_row long"


def index(rows: DataFrame, block: int = vectors.BLOCK) -> DataFrame:
    """The impact-ordered index of numbered rows (row, vec_id, vec): one row for each block, in a written table."""
    return scratch.table(vectors.blocks(rows.select("row", "vec_id", "vec"), _block, INDEX, block), "impacts")


def _block(t: pa.Table) -> dict:
    vec = vectors.matrix(t["vec"].combine_chunks())
    n, width = vec.shape
    members, segments = np.empty((width, n), np.uint16 if n <= 1 << 16 else np.uint32), []
    most = max(1, min(SEGMENTS, n // SEGMENT_ROWS))
    for d in range(width):
        order = np.argsort(vec[:, d], kind="stable")
        values = vec[order, d]
        starts = np.unique(np.searchsorted(values, values[np.arange(most) * n // most]))  # equal values stay together
        members[d] = order
        segments += [(d * n + a, d * n + b, d, values[a], values[b - 1]) for a, b in zip(starts, [*starts[1:], n])]
    data, kind = vectors.packed(vec)
    return {
        "ids": t["vec_id"].to_numpy().astype("<i8").tobytes(),
        "rows": t["row"].to_numpy().astype("<i8").tobytes(),
        "vec": data,
        "kind": kind,
        "width": width,
        "members": members.astype(f"<u{members.itemsize}").tobytes(),
        "segments": np.array(segments, "<i8").tobytes(),
    }


class Block:
    """A block's index while a task works on it."""

    def __init__(self, x: dict):
        self.ids, self.rows = np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["rows"], "<i8")
        n = len(self.ids)
        self.vec = np.frombuffer(x["vec"], x["kind"]).reshape(n, x["width"])
        self.members = np.frombuffer(x["members"], "<u2" if n <= 1 << 16 else "<u4").astype(np.intp)
        self.first, self.end, self.dim, self.low, self.high = np.frombuffer(x["segments"], "<i8").reshape(-1, 5).T
        self.sizes = self.end - self.first
        self.squares = np.square(self.vec.astype(np.float64)).sum(1)
        self.norm = float(np.sqrt(self.squares.mean()))

    def search(self, query: np.ndarray, own: int, best: vectors.Best) -> int:
        """Add this block's best rows for one query; the number of postings that it took is returned."""
        n, width = self.vec.shape
        q = np.zeros(width)
        q[: min(width, len(query))] = query[:width]
        size = float(np.sqrt(q @ q))
        w = self.norm / size if size and self.norm else 1.0
        bound = (w * size * size + self.squares / w) / 2
        slack = 1 + 1e-9 * float(bound.max(initial=0))  # for the rounding of the bounds; scores are integers
        at = np.sqrt(w) * q[self.dim]
        gap = np.maximum(np.maximum(self.low / np.sqrt(w) - at, at - self.high / np.sqrt(w)), 0)
        impact = gap * gap / 2
        order = np.argsort(-impact, kind="stable")
        order = order[: np.count_nonzero(impact)]
        bound[self.rows == own] = -np.inf
        few, step, i = max(n // 64, 4 * best.k), max(1, -(-len(order) // _LOOKS)), 0
        while i < len(order):
            part = order[i : i + step]
            i += step
            rows = np.concatenate([self.members[a:b] for a, b in zip(self.first[part].tolist(), self.end[part].tolist())])
            bound -= np.bincount(rows, weights=np.repeat(impact[part], self.sizes[part]), minlength=n)
            if best.least == -np.inf and i >= len(order) // 2:  # the first k exact scores: of the highest bounds
                self._score(query, np.argpartition(-bound, min(best.k, n - 1))[: best.k + 1], own, best)
            if best.least > -np.inf and np.count_nonzero(bound >= best.least - slack) <= few:
                break
        left = np.flatnonzero(bound >= best.least - slack)
        self._score(query, left, own, best)
        return int(self.sizes[order[:i]].sum())

    def _score(self, query: np.ndarray, rows: np.ndarray, own: int, best: vectors.Best) -> None:
        """Exact scores of some rows; those already among the best are left out."""
        held = {r for _, _, r in best.found} | {own}
        rows = rows[~np.isin(self.rows[rows], list(held))]
        scores = vectors.products(self.vec[rows], query)
        best.add(scores, self.ids[rows], self.rows[rows])


def _pass(indexed: DataFrame, chunk: vectors.Chunk, k: int) -> DataFrame:
    sent = indexed.sparkSession.sparkContext.broadcast((chunk.row, chunk.vec_id, chunk.vec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, vec = sent.value
        best = [vectors.Best(k) for _ in rows]
        for batch in batches:
            for x in range(batch.num_rows):
                block = Block(batch.slice(x, 1).to_pylist()[0])
                for i in range(len(rows)):
                    block.search(vec[i], rows[i], best[i])
        out = [(int(rows[i]), int(ids[i]), v, s, r) for i, b in enumerate(best) for s, v, r in b.rows()]
        names = ["query_row", "query_id", "vec_id", "score", "found_row"]
        for at in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + (1 << 16)])], names)

    return indexed.mapInArrow(run, FOUND)


def top_k(df: DataFrame, is_query: Column, k: int = 5, block: int = vectors.BLOCK) -> DataFrame:
    """For every row of ``df`` (vec_id, vec) that ``is_query`` holds for: its ``k`` best other rows.

    ``vec`` holds integers (see :func:`vectors.quantised`); rows whose ``vec`` is null take no part, as query or as
    candidate. Returns query_row, query_id, rank (from 1), vec_id, score and found_row; higher scores first, ties by
    smaller vec_id, then by row number. Rows that repeat an id are rows of their own: each is a query, and a candidate
    for the other. Fewer than ``k`` other rows give all of them; an empty table gives none.
    """
    rows = vectors.numbered(df.where(F.col("vec").isNotNull()).select("vec_id", "vec"), "vectors", block)
    indexed = index(rows, block)
    passes = (_pass(indexed, c, k) for c in vectors.chunks(rows.where(is_query), vectors.widest(rows), ()))
    found = scratch.union(rows.sparkSession, passes, FOUND, "found")
    scratch.drop(indexed)
    scratch.drop(rows)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "found_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score", "found_row")
