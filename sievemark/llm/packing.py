"""Best-fit packing of token sequences with large-item matching.

Lengths are whole numbers up to the capacity, so the corpus enters the plan only as a histogram of lengths,
whose size is bounded by the capacity. On it runs the packing itself: pieces of full capacity stand alone;
pieces above one third of the capacity are at most two to a sequence and are matched greedily, each
largest one with the largest that still fits; smaller pieces then go, longest first, into the sequence whose
gap they fit best. Sequences of equal content are one class, so each step moves whole counts and the
result is that of best-fit decreasing over single pieces. The plan says for each length which ranks go
to which sequences and offsets; pieces find their place by their rank within their length.
"""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, scratch

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Pieces of a stretch of ASCII and Latin-1 characters without white space, after lower-casing.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_SIMPLE = re.compile("[!-~\xa1-\xff]*")


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes, as the library gives them for the same file.

    White space parts pieces and is dropped by these vocabularies, so a text is cut at spaces and line
    feeds and each stretch encoded alone; stretches repeat and are kept in a bounded cache.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merge = bpe.merger(path)
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = bpe.Memo(self.stretch, 500_000)

    def stretch(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():  # one piece, by far the most
            return _packed(self.merge(text.lower().encode() + bpe.END))
        if _SIMPLE.fullmatch(text) is None or any(s in text for s in self.specials):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = list(chain.from_iterable(self.merge(p.encode() + bpe.END) for p in PIECE.findall(text.lower())))
        return _packed(ids)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each whole document, which ends with ``end_id``.

    Returns doc_id, piece (from 0), start (ids of the document before it), length and ids (binary, little-endian
    unsigned 32-bit). A null text is empty and yields the one piece that holds only ``end_id``; rows with a null
    or repeated doc_id are documents of their own. Only documents longer than the capacity are cut.
    """
    step = 4 * capacity
    last = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows, which, number, held = batch.num_rows, [], [], []
            texts = batch.column(1)
            for i in range(rows):
                ids = encode(texts[i].as_py() or "") + last
                for k in range(0, len(ids), step):
                    which.append(i)
                    number.append(k // step)
                    held.append(ids[k : k + step])
            piece = pa.array(number, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(which, pa.int64())),
                    piece,
                    pa.array(np.array(number, np.int64) * capacity, pa.int64()),
                    pa.array([len(x) // 4 for x in held], pa.int64()),
                    pa.array(held, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Classes (number of sequences, lengths in order of offset) that pack so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    classes: list[tuple[int, tuple[int, ...]]] = []
    third = capacity / 3
    large = sorted(n for n in left if n > third)
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps: list[int] = []

    def put(count: int, held: tuple[int, ...]) -> None:
        gap = capacity - sum(held)
        if gap == 0:
            classes.append((count, held))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((count, held))

    while large:
        n = large[-1]
        fits = bisect_left(large, capacity - n + 1) - 1
        if fits < 0:
            put(left.pop(n), (n,))
            large.pop()
            continue
        m = large[fits]
        if m == n:
            if left[n] > 1:
                put(left[n] // 2, (n, n))
            left[n] %= 2
            if left[n] == 0:
                large.pop()
            elif fits > 0:
                m = large[fits - 1]
                put(1, (n, m))
                left[m] -= 1
                large.pop()
                if left[m] == 0:
                    large.remove(m)
            else:
                put(1, (n,))
                large.pop()
            continue
        k = min(left[n], left[m])
        put(k, (n, m))
        left[n] -= k
        left[m] -= k
        if left[m] == 0:
            large.pop(fits)
        if left[n] == 0:
            large.pop()
    for n in sorted((x for x in left if x <= third), reverse=True):
        need = left[n]
        while need:
            at = bisect_left(gaps, n)
            if at == len(gaps):  # no sequence has room: fill new ones
                each = capacity // n
                if need >= each:
                    put(need // each, (n,) * each)
                    need %= each
                if need:
                    put(1, (n,) * need)
                    need = 0
                continue
            gap = gaps[at]
            count, held = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            fit = gap // n  # after the first, the same sequence is still the best fit
            if need >= fit * count:
                put(count, held + (n,) * fit)
                need -= fit * count
            else:
                full, some = divmod(need, fit)
                if full:
                    put(full, held + (n,) * fit)
                if some:
                    put(1, held + (n,) * some)
                if count - full - bool(some):
                    open_.setdefault(gap, [])
                    if not open_[gap]:
                        insort(gaps, gap)
                    open_[gap].append((count - full - bool(some), held))
                need = 0
    for gap in gaps:
        classes.extend(open_[gap])
    return classes


def places(classes: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of its runs, first sequence of each run, offset of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for count, held in classes:
        offset = 0
        for n in held:
            rank = used.get(n, 0)
            runs.setdefault(n, []).append((rank, first, offset))
            used[n] = rank + count
            offset += n
        first += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset (gapless from 0), in as few sequences as best fit finds.

    ``pieces`` has doc_id, piece and length from 1 to ``capacity``; further columns are carried along. It should
    be a written table, since it is read twice. Pieces of one length are ranked in buckets of a
    hash, so that a length shared by a third of all rows is no single task; equal rows take different places.
    """
    spark: SparkSession = pieces.sparkSession
    pieces, named = scratch.apart(pieces, "doc_id", "piece", "length", without=("sequence_id", "offset"))
    buckets = max(8, 2 * scratch.shuffle_partitions(spark))
    slim = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = slim.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    histogram = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(places(pack_lengths(histogram, capacity)))  # bounded by the capacity, not by rows
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", F.xxhash64(*[f.name for f in pieces.schema if "map<" not in f.dataType.simpleString()]))
    ranked = (
        slim.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .select(*pieces.columns, F.col("_rank"))
    )
    names = list(pieces.columns)
    n_cols, at = len(names), names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        for batch in batches:
            length, rank = batch.column(at).to_numpy(zero_copy_only=False), batch.column(n_cols).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, bounds):
                if len(own):
                    ranks, firsts, offsets = runs[int(length[own[0]])]
                    k = np.searchsorted(ranks, rank[own], side="right") - 1
                    sequence[own] = firsts[k] + rank[own] - ranks[k]
                    offset[own] = offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return named(ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (binary), from pieces that carry ``ids``."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("_held")).select("sequence_id", F.expr("aggregate(_held, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
