"""Histogram sort's splitters: candidate key boundaries, exact sizes below them, refined until near enough.

A key is a pair of longs (k1, k2) in signed order. The first round counts the rows and bytes in at most 4097
equal cells of k1's range; each later round divides only the cells in which a splitter must lie, 256 to one,
first by further bits of k1 and, where one k1 alone is too heavy, by bits of k2. Every round is one
aggregation with partial sums; the driver sees at most 4097 + 256 * splitters rows a round, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW = -(1 << 63)
_FIRST_BITS, _BITS = 12, 8


@dataclass(frozen=True)
class Splitter:
    """Rows with (k1, k2) below these lie before it; ``rows`` and ``size`` of them are exact."""

    k1: int
    k2: int
    rows: int
    size: int


@dataclass(frozen=True)
class Splitters:
    """Splitters in order; part p is what lies between splitter p-1 and p. ``shift``: of the lookup's cells."""

    found: tuple[Splitter, ...]
    shift: int
    rounds: int
    total_rows: int
    total_size: int

    @property
    def rows_before(self) -> list[int]:
        """Rows before each part."""
        return [0, *(s.rows for s in self.found)]

    def part(self, df: DataFrame, k1: str, k2: str, out: str) -> DataFrame:
        """``df`` with each row's part: a join with one small row for each cell that some splitter lies in."""
        spark = df.sparkSession
        cells: dict[int, list[Splitter]] = {}
        for s in self.found:
            cells.setdefault(s.k1 >> self.shift, []).append(s)
        firsts = sorted(cells)
        before = dict(zip(firsts, accumulate([0, *(len(cells[c]) for c in firsts[:-1])])))
        if not firsts:
            return df.withColumn(out, F.lit(0))
        low, high = firsts[0], firsts[-1]
        rows, base = [], 0  # at most 4097 cells, by the choice of shift
        for c in range(low, high + 1):
            own = cells.get(c, [])
            base = before.get(c, base)
            rows.append((c, base, [(s.k1, s.k2) for s in own]))
            base += len(own)
        table = spark.createDataFrame(rows, "_cell long, _base int, _own array<struct<a: long, b: long>>")
        at = F.shiftright(F.col(k1), self.shift)
        clipped = F.least(F.greatest(at, F.lit(low)), F.lit(high))
        joined = df.withColumn("_cell", clipped.cast("long")).join(F.broadcast(table), "_cell")
        below = F.filter("_own", lambda s: (s["a"] < F.col(k1)) | ((s["a"] == F.col(k1)) & (s["b"] <= F.col(k2))))
        return joined.withColumn(out, F.col("_base") + F.size(below)).drop("_cell", "_base", "_own")


def find(keys: DataFrame, parts: int, tolerance: float = 0.001) -> Splitters:
    """Splitters of ``keys`` (k1, k2, size; longs without nulls) into ``parts`` of equal size.

    Each splitter's size is within ``tolerance`` of a part from its target, or as near as whole rows (equal
    keys are one) allow. ``keys`` is read once a round and should be a written table.
    """
    top = keys.agg(F.min("k1"), F.max("k1"), F.sum("size"), F.count(F.lit(1))).first()
    low, high, total, rows = top[0], top[1], top[2] or 0, top[3]
    if not rows or parts < 2:
        return Splitters((), 0, 0, rows, total)
    shift = max(0, (high - low).bit_length() - _FIRST_BITS)
    near = tolerance * total / parts
    open_ = {j: total * j / parts for j in range(1, parts)}
    done: dict[int, Splitter] = {}
    # a cell: (k1 prefix, None) or (k1, k2 prefix); with the rows and bytes before it
    active: dict[tuple, list[int]] = {(): list(open_)}
    start: dict[tuple, tuple[int, int]] = {(): (0, 0)}
    level, key_bits, rounds = "k1", shift, 0
    while active:
        rounds += 1
        if level == "k1":
            cell = [F.shiftright("k1", key_bits).alias("c")]
            parent_bits = None if () in active else last_bits
            where = F.lit(True) if parent_bits is None else F.shiftright("k1", parent_bits).isin([p[0] for p in active])
            up: list[Column] = [F.lit(0).cast("long")] if parent_bits is None else [F.shiftright("k1", parent_bits).cast("long")]
        else:
            cell = [F.shiftright("k2", key_bits).alias("c")]
            if len(next(iter(active))) == 1:
                where, up = F.col("k1").isin([p[0] for p in active]), [F.col("k1")]
            else:
                where, up = F.lit(True), [F.col("k1"), F.shiftright("k2", last_bits).cast("long")]
        some = keys.where(where)
        if level == "k2" and len(up) == 2:  # as many cells as splitters, as a table: a condition for each is too deep to plan
            cells = keys.sparkSession.createDataFrame(list(active), "_cell1 long, _cell2 long")
            some = some.join(F.broadcast(cells), (up[0] == F.col("_cell1")) & (up[1] == F.col("_cell2")), "left_semi")
        counted = (
            some
            .groupBy(*[u.alias(f"u{i}") for i, u in enumerate(up)], *cell)
            .agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        by: dict[tuple, list[tuple[int, int, int]]] = {}
        for r in counted:
            parent = () if () in active else tuple(r[f"u{i}"] for i in range(len(up)))
            by.setdefault(parent, []).append((r["c"], r["s"], r["n"]))
        next_active: dict[tuple, list[int]] = {}
        next_start: dict[tuple, tuple[int, int]] = {}
        for parent, js in active.items():
            n0, s0 = start[parent]
            todo = sorted(js)
            for c, s, n in sorted(by.get(parent, [])):
                inside = [j for j in todo if open_[j] <= s0 + s]
                todo = [j for j in todo if open_[j] > s0 + s]
                for j in inside:
                    last = key_bits == 0 and level == "k2"
                    if s <= near or n == 1 or last or min(open_[j] - s0, s0 + s - open_[j]) <= near:
                        after = open_[j] - s0 > s0 + s - open_[j]
                        done[j] = _boundary(level, parent, c + after, key_bits, n0 + n * after, s0 + s * after)
                    else:
                        child = (c,) if level == "k1" else (parent[0], c)
                        next_active.setdefault(child, []).append(j)
                        next_start[child] = (n0, s0)
                n0, s0 = n0 + n, s0 + s
            for j in todo:  # only by rounding, past the last row
                done[j] = Splitter((1 << 63) - 1, (1 << 63) - 1, n0, s0)
        active, start, last_bits = next_active, next_start, key_bits
        if key_bits == 0 and level == "k1":
            level, key_bits = "k2", 64 - _BITS
        else:
            key_bits = max(0, key_bits - _BITS)
    best = sorted(done.values(), key=lambda s: (s.k1, s.k2))
    return Splitters(tuple(best), shift, rounds, rows, total)


def _boundary(level: str, parent: tuple, cell: int, bits: int, rows: int, size: int) -> Splitter:
    value = cell << bits
    if level == "k1":
        return Splitter(value, _LOW, rows, size) if value < 1 << 63 else Splitter((1 << 63) - 1, (1 << 63) - 1, rows, size)
    if value < 1 << 63:
        return Splitter(parent[0], value, rows, size)
    return Splitter(parent[0] + 1, _LOW, rows, size) if parent[0] < (1 << 63) - 1 else Splitter((1 << 63) - 1, (1 << 63) - 1, rows, size)
