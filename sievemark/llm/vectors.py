"""Integer vectors for exact inner products: numbered rows in a written table, blocks of them, query rows in chunks.

A vector that is null or holds a null or a non-finite component takes no part. Vectors of different lengths are
compared as if the shorter one went on with zeros; an empty vector scores zero with every other. Components and scores
beyond the range of a long stop at its ends. Rows are told apart by a number of their own (``row``), so repeated ids
and repeated vectors stay separate rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Vectors of a block, for which one task holds an index at a time.
BLOCK = 8192
#: Bytes of the query vectors that are sent to all tasks at once; more queries take another pass over the index.
QUERY_BYTES = 8 << 20
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null where the vector takes no part."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def numbered(df: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` (with a column ``vec`` of longs, none null) with a number ``row``, written in files of about ``block`` rows."""
    n = df.count()
    return scratch.table(df.repartition(max(1, -(-n // block))).withColumn("row", F.monotonically_increasing_id()), name)


def matrix(vectors: pa.Array) -> np.ndarray:
    """A column of lists of longs as one matrix, short rows filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(m.astype(np.float64)).sum(1))


def products(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers with one more, as longs."""
    width = min(many.shape[1], len(one))
    many, one = many[:, :width], one[:width]
    most = float(np.abs(many.astype(np.float64)).max(initial=0)) * float(np.abs(one.astype(np.float64)).max(initial=0)) * width
    if most < _EXACT:
        return (many.astype(np.float64) @ one.astype(np.float64)).astype(np.int64)
    whole = many.astype(object) @ one.astype(object)
    return np.array([max(-_LONG - 1, min(_LONG, int(x))) for x in whole], np.int64)


def packed(m: np.ndarray) -> tuple[bytes, str]:
    """A matrix of integers in as few bytes as hold it, and their kind."""
    low, high = (int(m.min()), int(m.max())) if m.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return m.astype(kind).tobytes(), kind


@dataclass(frozen=True)
class Chunk:
    """Query rows that are searched in one pass."""

    row: np.ndarray
    vec_id: np.ndarray
    vec: np.ndarray
    more: dict[str, list]


def chunks(queries: DataFrame, width: int, more: tuple[str, ...] = ()) -> Iterator[Chunk]:
    """The query rows (row, vec_id, vec and ``more``) in chunks whose vectors take about QUERY_BYTES, by a hash of their number."""
    n = -(-queries.count() * max(1, width) * 8 // QUERY_BYTES)
    for k in range(n):
        got = queries.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k).select("row", "vec_id", "vec", *more).toArrow()
        if got.num_rows:
            vec = matrix(got["vec"].combine_chunks())
            yield Chunk(got["row"].to_numpy(), got["vec_id"].to_numpy(), vec, {c: got[c].to_pylist() for c in more})


def widest(rows: DataFrame) -> int:
    """The longest vector's length."""
    return rows.agg(F.max(F.size("vec"))).first()[0] or 0


def blocks(rows: DataFrame, build: Callable[[pa.Table], dict], schema: str, size: int = BLOCK) -> DataFrame:
    """One row for every ``size`` rows of a partition, as ``build`` makes it of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, size - n))
                at += held[-1].num_rows
                n += held[-1].num_rows
                if n == size:
                    yield pa.RecordBatch.from_pylist([build(pa.Table.from_batches(held))])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pylist([build(pa.Table.from_batches(held))])

    return rows.mapInArrow(run, schema)


class Best:
    """The best rows found so far for one query: higher scores first, ties by smaller id, then by smaller row number."""

    def __init__(self, k: int):
        self.k = k
        self.found: list[tuple[int, int, int]] = []

    @property
    def least(self) -> float:
        """What a row must score at least to be among the best."""
        return self.found[-1][0] * -1.0 if len(self.found) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > self.k:
            keep = np.lexsort((rows, ids, ~scores))[: self.k]
            scores, ids, rows = scores[keep], ids[keep], rows[keep]
        new = zip((-int(s) for s in scores), ids.tolist(), rows.tolist())
        self.found = sorted([*self.found, *new])[: self.k]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """Score, id and row number."""
        return ((-s, i, r) for s, i, r in self.found)
