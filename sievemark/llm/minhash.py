"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``SIZE`` coordinates. In round i every shingle falls into a hashed bin with value (i, fraction);
from round SIZE on, all shingles fall into bin i - SIZE, so after at most 2 * SIZE rounds every
coordinate is filled, usually after a few. Each coordinate keeps its least value, so two sets agree in
it with the probability of their similarity, with the concentration of independent coordinates.
Bands of four coordinates make candidates: two sets of similarity 0.75 share none of the 32 bands with
probability 6e-6. Candidates are confirmed on full shingle sets.

Candidates are not emitted as all pairs of a bucket. First each bucket's members are compared with its least
one, and links make components. A bucket all of whose members are then in one component has no more to
tell; members of the others are compared in blocks, each pair of blocks in a task of bounded size, and
only links between components leave it. So every pair that shares a band is either confirmed,
refuted, or already connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, scratch, words

_U = np.uint64
SIZE, ROWS = 128, 4
#: Most members and most shingles of a block, and columns of a matrix.
BLOCK, BLOCK_ITEMS, SLICE = 512, 1 << 20, 1 << 13
_SEEDS = words.mix(np.arange(1, 2 * SIZE + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BANDS = words.mix(np.arange(1, SIZE // ROWS + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def sketch(items: np.ndarray) -> np.ndarray:
    """Sketch of a set of distinct 64-bit hashes; not of an empty one."""
    bins = np.full(SIZE, _FULL, _U)
    step = max(1, ceil(700 / len(items)))
    for first in range(0, 2 * SIZE, step):
        rounds = np.arange(first, min(first + step, 2 * SIZE))
        drawn = words.mix(items[None, :] ^ _SEEDS[rounds][:, None])
        place = drawn & _U(SIZE - 1)
        late = rounds >= SIZE
        if late.any():
            place[late] = (rounds[late] - SIZE).astype(_U)[:, None]
        value = (drawn >> _U(9)) | (rounds.astype(_U) << _U(55))[:, None]
        np.minimum.at(bins, place.ravel().astype(np.intp), value.ravel())
        if (bins != _FULL).all():
            break
    return bins


def bands(bins: np.ndarray) -> np.ndarray:
    parts = bins.reshape(-1, ROWS)
    acc = _BANDS.copy()
    for k in range(ROWS):
        acc = words.mix(acc ^ parts[:, k]) * _U(0x9E3779B97F4A7C15)
    return acc


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, texts in words.chunks(column):
        found, at = words.hashes(texts)
        for i in range(len(texts)):
            yield np.unique(words.shingles(found[at[i] : at[i + 1]], width))


def _key(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def sketched(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (of the shingle set; null if empty) and bands of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, banded = [], [], []
            for items in _sets(batch.column(1), width):
                n.append(len(items))
                keys.append(_key(items))
                banded.append(words.signed(bands(sketch(items))) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """set_key and the whole shingle set (sorted 64-bit hashes, binary) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in _sets(batch.column(0), width) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["set_key", "items"])

    return docs.select("text").mapInArrow(run, "set_key binary, items binary")


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _views(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of binary sets, without a copy, and where each begins."""
    kind = np.int64 if pa.types.is_large_binary(sets.type) else np.int32
    at = np.frombuffer(sets.buffers()[1], kind)[sets.offset : sets.offset + len(sets) + 1] // 8
    return np.frombuffer(sets.buffers()[2] or b"", _U), at


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: set keys) that are near on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at), (y, to) = (_views(batch.column(k)) for k in (2, 3))
            ok = [_near(x[at[i] : at[i + 1]], y[to[i] : to[i + 1]], percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.select(F.col("set_key").alias("a"), F.col("items").alias("x")), sets.select(F.col("set_key").alias("b"), F.col("items").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of one block's sets with another's, by products of 0/1 matrices.

    Only shingles that occur twice have a column; columns are taken in slices, so memory is bounded by the blocks.
    """
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    total = np.zeros((len(left), len(right)), np.float64)
    if len(column) == 0:
        return total
    column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
    for first in range(0, int(column[-1]) + 1, SLICE):
        a, b = np.searchsorted(column, [first, first + SLICE])
        m = np.zeros((len(left) + len(right), SLICE), np.float32)
        m[owner[a:b], column[a:b] - first] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total


def _blocks(percent: int):
    """Compare two blocks of one bucket; a link leaves only if it joins what is not yet joined here."""

    def run(table: pa.Table) -> pa.Table:
        keys, comps = (table.column(c).to_pylist() for c in ("set_key", "comp"))
        side = np.array(table.column("side").to_pylist())
        items = [np.frombuffer(x, _U) for x in table.column("items").to_pylist()]
        sizes = np.array([len(x) for x in items])
        codes = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)[1]
        one = side.min() == side.max()
        rows, cols = (np.arange(len(keys)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        common = _common([items[i] for i in rows], [items[j] for j in cols])
        near = 100 * common >= percent * (sizes[rows][:, None] + sizes[cols][None, :] - common)
        near &= codes[rows][:, None] != codes[cols][None, :]
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            i, j = int(rows[i]), int(cols[j])
            ri, rj = root(int(codes[i])), root(int(codes[j]))
            if ri != rj:
                up[ri] = rj
                out.append((keys[i], keys[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def groups(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set holds its distinct ``width``-word
    shingles, or its whole sequence if shorter. Documents are linked when 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable over links; kept says whether it is the document's own.
    Documents without words or text have an empty set and are linked with nothing. Rows that repeat a
    doc_id are documents of their own with the same verdict if their texts are equal. Rows without
    doc_id take part; theirs is a null component_id only if no document reachable has one, and kept is then true.
    Further columns of ``docs`` are ignored.
    """
    rows = scratch.table(sketched(docs, width), "sketches")
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.any_value("n_shingles").alias("items"), F.any_value("bands").alias("bands"))
    classes = scratch.table(classes, "classes")  # here and below: both sides of a join plain shuffles, so that Spark can split heavy keys
    members = scratch.table(classes.select("set_key", "items", F.explode("bands").alias("band")), "bands")
    buckets = members.groupBy("band").agg(F.min("set_key").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("items").alias("items")).where("n > 1")
    buckets = scratch.table(buckets, "buckets")
    nb = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("items") / BLOCK_ITEMS)).cast("int")
    shared = scratch.table(members.drop("items").join(buckets, "band").select("band", "set_key", "a", "n", nb.alias("nb")), "shared")
    stars = scratch.table(shared.where(F.col("set_key") != F.col("a")).select("a", F.col("set_key").alias("b")).distinct(), "stars")
    if stars.isEmpty():
        links = None
    else:
        wanted = scratch.table(shared.select("set_key").distinct(), "wanted")
        scratch.release(docs.sparkSession)  # here and below: what earlier steps shuffled is as large as the input
        sets = scratch.table(_wanted_sets(docs, rows, wanted, width), "sets")
        scratch.release(docs.sparkSession)
        near = scratch.table(confirmed(stars, sets, percent), "near")
        scratch.release(docs.sparkSession)
        comps = components.connected(near)
        known = shared.where("n > 2").join(comps.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("comp", F.coalesce("root", "set_key"))
        known = scratch.table(known, "known")
        mixed = scratch.table(known.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band"), "mixed")
        rest = known.join(mixed, "band").select("band", "set_key", "comp", "nb")
        block = F.pmod(F.xxhash64("set_key"), F.col("nb")).cast("int")
        dealt = rest.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "set_key", "comp")
        more = dealt.join(sets, "set_key").groupBy("band", "i", "j").applyInArrow(_blocks(percent), "a binary, b binary")
        links = near.union(scratch.table(more, "more"))
        scratch.drop(sets)
        scratch.release(docs.sparkSession)
    return _labelled(rows, classes.select("set_key", "first"), links)


def _wanted_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full sets of the classes in ``wanted``: their texts are read again, one document for each class."""
    ids = rows.join(wanted, "set_key", "left_semi").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = scratch.by_ids(docs.select("doc_id", "text"), scratch.table(ids, "ids"), "left_semi")
    return full_sets(texts, width).join(wanted, "set_key", "left_semi").dropDuplicates(["set_key"])


def _labelled(rows: DataFrame, classes: DataFrame, links: DataFrame | None) -> DataFrame:
    slim = rows.select("doc_id", "n_shingles", "set_key")
    if links is None:
        joined = slim.join(classes, "set_key", "left").withColumn("least", F.col("first"))
    else:
        roots = scratch.table(components.connected(links), "roots")
        named = classes.join(roots.withColumnRenamed("node", "set_key"), "set_key").groupBy("root").agg(F.min("first").alias("of_root"))
        of_class = roots.join(named, "root").select(F.col("node").alias("set_key"), "of_root")
        final = scratch.table(classes.join(of_class, "set_key", "left").withColumn("least", F.coalesce("of_root", "first")), "final")
        joined = slim.join(final, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    All columns are kept. If that doc_id has several rows, rows with equal texts count once.
    """
    kept = scratch.table(groups(docs, percent, width).where("kept").select("doc_id"), "kept")
    once = scratch.table(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "once")
    some = scratch.by_ids(docs, once.select("doc_id"), "left_semi")  # texts are shuffled only where the ids are too many to broadcast
    if once.where("n > 1").isEmpty():
        return some
    some, named = scratch.apart(some, "doc_id", "text")
    return named(some.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text"))
