"""Language-model scores by online logistic context mixing.

Tokens are words and one end for each text; every one is coded, bit by bit, from mixed predictions. The corpus gives
exact counts of all training tokens. Frequent words, the end, and an escape for all other words have a prefix code each
(Huffman's, by count). A word that the training texts hold once also counts as an escape, as it was new when it came. A token's first bit says whether it is the word
before again; if not, the bits of its code follow. Each bit is predicted from its place in the code together with
the last very frequent word before it (which tells the language, and the grammar's place), the word before, and the
two words before. Each context is hashed into a table of counts of zeros and ones over all training texts, whose size
follows the vocabulary; counts of partitions are summed, so they don't depend on how rows are dealt.

The predictions are mixed in the logistic domain by weights that the depth and the contexts seen before select
(gates). Mixing is online within each text: weights start from ``start_weights``, the same for all texts, and after
each stretch of tokens (``STRETCHES``) they learn from what came; a table of what really came, by the mixed prediction,
refines it in the same way. A text's score therefore depends on the counts and on itself only. Texts are worked
on side by side, all at the same stretch, so numpy sees long arrays though no text waits for another.

An escaped word is spelled, byte by byte and bit by bit, with a space as its end, by a mixer of the same kind
whose contexts stay within the word: the position, the last one to four bytes, the whole word so far. Its tables
count every training word once; its weights are learned over the training words that occur once, each with
its own share of the counts taken out, in groups by hash, each in the order of its words.

What executors share is of bounded size: tables, weights, and the codes and counts of the most frequent words. All other
words meet their counts and their spelling by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

_U = np.uint64
ORDERS, SLOT_BITS, BLOCK = 6, 18, 4096
GATES, INPUTS, REFINE = 32, ORDERS + 1, 33
#: Contexts of a code's bits, depths told apart, gates (by depth and whether the two longest contexts were seen).
VIEWS, DEPTHS = 3, 16
WORD_GATES = 4 * DEPTHS
#: Least bits of a table's slots, and most for each view.
LEAST_BITS, MOST_BITS = 16, (20, 21, 21)
#: A text's stretches of tokens end here; further ones are of the last length each.
STRETCHES = np.array([32, 64, 128, 256, 512, 1024, 2048, 4096], np.int64)
#: Step of the weights, tokens' weight of their start, and of a mixed prediction against what came of its like.
RATE, INERTIA, TRUST = 1.0, 8.0, 12.0
#: Tokens, and words, that a task counts at least where there are so many, as each task hands on tables of one size.
TASK_TOKENS, TASK_WORDS = 2_000_000, 250_000
#: Most words of a group in which spelling is learned.
GROUP = 1 << 17
#: Most words that have codes, and most others whose counts are broadcast.
HEAD = 200_000
#: Most tables of counting tasks that are summed in one group; where there are more, they are summed in two levels.
SUMMED = 256
#: Tokens, about, of which scoring takes the bits at a time.
PIECE = 4096
#: Bytes of texts, about, whose words are looked up at a time.
CHUNK = 1 << 19
#: Short words that a task holds, and different long ones, before it hands on their counts.
POOL, _FLUSH = 1 << 21, 200_000
#: Very frequent words, one of which is a context until the next comes.
MARKERS = 64
_SALT = words.mix(np.arange(1, ORDERS + 1, dtype=_U))
_VIEW_SALT = words.mix(np.arange(101, 101 + VIEWS, dtype=_U))
_C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def contexts(some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, each ended by a space; where words start; positions; mixed contexts, a row for each order."""
    flat = np.frombuffer(b" ".join([*some, b""]), np.uint8)
    sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    begin = np.repeat(starts, sizes)
    at = np.arange(len(flat)) - begin
    last = np.zeros(len(flat), _U)
    rows = [np.minimum(at, 15).astype(_U)]
    for k in range(1, 5):
        shifted = np.zeros(len(flat), _U)
        shifted[k:] = flat[:-k].astype(_U) + _U(1)
        shifted[at < k] = 0
        last = last | (shifted << _U(9 * (k - 1)))
        rows.append(last.copy())
    power, inverse = words._power(len(flat) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum((flat.astype(_U) + _U(1)) * power[: len(flat)])]).astype(_U)
    rows.append((sums[:-1] - sums[begin]) * inverse[begin])
    return flat, starts, at, np.stack([words.mix(r + s) for r, s in zip(rows, _SALT)])


def slots(mixed: np.ndarray, flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the eight bits: its number, its table slots in each order, and its values. Four bits' slots are side by side: one line of a core's cache."""
    for half in (0, 4):
        above, byte = (flat >> 4) + np.uint8(16) if half else np.ones(len(flat), np.uint8), flat.astype(np.int64)
        line = mixed ^ (above.astype(_U) * _C1)[None, :]
        line *= _C2
        line >>= _U(64 - SLOT_BITS)
        for k in range(half, half + 4):
            within = (1 << (k - half)) | ((byte >> (8 - k)) & ((1 << (k - half)) - 1))
            yield k, line.view(np.int64) ^ within[None, :], (flat >> (7 - k)) & 1


def _batches(column: pa.Array, each: int = 512) -> Iterator[list[bytes]]:
    held = column.to_pylist()
    for i in range(0, len(held), each):
        yield held[i : i + each]


def gate(k: int, at: np.ndarray) -> np.ndarray:
    return k * 4 + np.minimum(at, 3)


def inputs(tables: np.ndarray, place: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Stretched predictions of all orders and a bias, without the word's own share; tables of zeros and ones, slot by slot."""
    out = np.empty((INPUTS, place.shape[1]), np.float32)
    own = bit.astype(np.float32)
    for o in range(ORDERS):
        both = np.take(tables[o].view(np.complex64), place[o], mode="wrap")  # zeros and ones are side by side; all are within
        out[o] = np.log((both.imag - own + np.float32(0.2)) / (both.real - (1 - own) + np.float32(0.2)))
    out[-1] = 0.3
    return out


def mixed_of(x: np.ndarray, weights: np.ndarray, gates: np.ndarray) -> np.ndarray:
    total = x[0] * np.take(weights[0], gates)
    for row, w in zip(x[1:], weights[1:]):
        total += row * np.take(w, gates)
    return total


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * 2), -16, 16).astype(np.int64) + 16


def log10_spelled(some: list[bytes], stretched: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 probability of each word's spelling, its end included."""
    flat, starts, at, mixed = contexts(some)
    total = np.zeros(len(flat))
    weights, part = weights.T.astype(np.float32), (3 * (refined[1] + 0.5) / (refined.sum(axis=0) + 1)) / 4
    x = np.full((INPUTS, len(flat)), 0.3, np.float32)
    for k, place, bit in slots(mixed, flat):
        for o in range(ORDERS):
            np.take(stretched[o], place[o], out=x[o], mode="wrap")  # all are within; the mode spares a check
        y = mixed_of(x, weights, gate(k, at))
        p = squash(y) / 4 + part[k][_bucket(y)]
        total += np.log(np.clip(np.where(bit == 1, p, 1 - p), 1e-9, 1))
    return np.add.reduceat(total, starts) / log(10)


def stretched_counts(tables: np.ndarray) -> np.ndarray:
    return np.log((tables[:, 1::2] + np.float32(0.2)) / (tables[:, ::2] + np.float32(0.2)))


def _count_tables(vocabulary: DataFrame, n_words: int) -> np.ndarray:
    """Counts of zeros and ones over all ``n_words`` training words, slot by slot: (order, 2 * slot + bit)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((ORDERS, 2 << SLOT_BITS), np.int32)
        for batch in batches:
            for some in _batches(batch.column(0), 4096):
                flat, _, _, mixed = contexts(some)
                one = np.ones(len(flat), np.int32)
                for _, place, bit in slots(mixed, flat):
                    place *= 2
                    place += bit
                    for o in range(ORDERS):
                        np.add.at(tables[o], place[o], one)
        flat = tables.reshape(-1, BLOCK)
        used = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([flat[i].tobytes() for i in used], pa.binary())], names=["block", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in group.column("n"):
            total += np.frombuffer(x.as_py(), np.int32)
        return pa.table({"block": group.column("block").slice(0, 1), "n": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    summed = vocabulary.select("word").coalesce(max(8, n_words // TASK_WORDS)).mapInArrow(count, "block long, n binary").groupBy("block").applyInArrow(add, "block long, n binary")
    out = np.zeros((ORDERS * 2 << SLOT_BITS) // BLOCK * BLOCK, np.float32).reshape(-1, BLOCK)
    for r in summed.toLocalIterator():  # a table of fixed size
        out[r["block"]] = np.frombuffer(bytes(r["n"]), np.float32)
    return out.reshape(ORDERS, 2 << SLOT_BITS)


def _weights(once: DataFrame, tables) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights and refinement counts, learned online in groups of words by hash, then averaged and summed."""
    groups = max(64, -(-once.count() // GROUP))

    def learn(group: pa.Table) -> pa.Table:
        weights, refined, seen = np.full((INPUTS, GATES), 0.25, np.float32), np.zeros((2, 8, REFINE)), 0
        for some in _batches(pa.array(sorted(group.column("word").to_pylist()), pa.binary())):
            flat, _, at, mixed = contexts(some)
            rate = 0.3 / (1 + seen / 20_000) ** 0.5
            for k, place, bit in slots(mixed, flat):
                x = inputs(tables.value, place, bit)
                g = gate(k, at)
                mixed_x = mixed_of(x, weights, g)
                error = (bit - squash(mixed_x)).astype(np.float32)
                n = np.maximum(np.bincount(g, minlength=GATES), 1)
                for row, w in zip(x, weights):
                    w += (rate * np.bincount(g, row * error, GATES) / n).astype(np.float32)
                where = _bucket(mixed_x)
                for b in (0, 1):
                    refined[b, k] += np.bincount(where[bit == b], minlength=REFINE)
            seen += len(some)
        return pa.table({"part": group.column("part").slice(0, 1), "seen": pa.array([seen], pa.int64()), "w": pa.array([weights.T.astype(float).tobytes()], pa.binary()), "r": pa.array([refined.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("part", "seen", "w", "r"))))
        w = sum(n * np.frombuffer(x) for _, n, x, _ in rows)
        r = sum(np.frombuffer(x) for *_, x in rows)
        return pa.table({"part": [rows[0][0]], "seen": [sum(n for _, n, _, _ in rows)], "w": pa.array([w.tobytes()], pa.binary()), "r": pa.array([r.tobytes()], pa.binary())})

    schema = "part long, seen long, w binary, r binary"
    learned = once.select("word", F.pmod(F.xxhash64("word"), F.lit(groups)).alias("part")).groupBy("part").applyInArrow(learn, schema)
    total, weights, refined = 0, np.zeros((GATES, INPUTS)), np.zeros((2, 8, REFINE))
    for r in sorted(learned.groupBy(F.pmod("part", F.lit(64))).applyInArrow(add, schema).collect()):  # at most 64 rows
        total += r["seen"]
        weights += np.frombuffer(bytes(r["w"])).reshape(GATES, INPUTS)
        refined += np.frombuffer(bytes(r["r"])).reshape(2, 8, REFINE)
    return (weights / total if total else np.full((GATES, INPUTS), 0.25)), refined


def prefix_codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's code starts, and the nodes and bits of all codes: Huffman's, each after a zero at one more node, and last the code of a copy, a one there."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    weights = [*np.asarray(counts)[order].tolist(), *[0] * (n - 1)]
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    leaf, inner = 0, n
    for k in range(n, 2 * n - 1):
        for bit in (0, 1):
            if leaf < n and (inner >= k or weights[leaf] <= weights[inner]):
                least, leaf = leaf, leaf + 1
            else:
                least, inner = inner, inner + 1
            parent[least], side[least] = k, bit
            weights[k] += weights[least]
    root, here, climbed = 2 * n - 2, np.arange(n), []
    depth = np.zeros(n, np.int64)
    while (below := here != root).any():
        climbed.append((np.flatnonzero(below), parent[here[below]], side[here[below]]))
        depth[below] += 1
        here = np.where(below, parent[here], here)
    of_symbol = np.empty(n, np.int64)
    of_symbol[order] = depth + 1
    at = np.concatenate([[0], np.cumsum(of_symbol), [of_symbol.sum() + 1]])
    node, bits = np.full(at[-1], n - 1, np.int32), np.zeros(at[-1], np.uint8)
    for step, (those, up, which) in enumerate(climbed):
        place = at[order[those]] + depth[those] - step
        node[place], bits[place] = root - up, which
    bits[-1] = 1
    return at, node, bits


class Coder:
    """Codes of symbols: words by their place in ``coded``, then the end, then the escape, then a copy."""

    def __init__(self, coded: list[bytes], counts: np.ndarray, ends: int, rest: int, slot_bits: int):
        self.coded, self.slot_bits = coded, [min(slot_bits, most) for most in MOST_BITS]
        self.once = np.append(counts == 1, np.zeros(4, bool))
        self.end, self.escape, self.copy, self.start = len(coded), len(coded) + 1, len(coded) + 2, len(coded) + 3
        self.at, node, bit = prefix_codes(np.concatenate([counts, [max(ends, 1), max(rest, 1)]]))
        depth = np.arange(len(bit), dtype=np.uint32) - np.repeat(self.at[:-1].astype(np.uint32), np.diff(self.at))
        level, within = depth & 3, np.ones(len(bit), np.uint32)  # subtrees of four levels have 16 slots side by side: one line of a core's cache
        for k in (3, 2, 1):
            deep = np.flatnonzero(level >= k)
            within[deep] = within[deep] << np.uint32(1) | bit[deep - k]
        #: Top of the subtree, place within it, depth and value of each bit in one array: they are read together.
        self.code = (node[np.arange(len(bit), dtype=np.uint32) - level].astype(np.uint32) + np.uint32(1)) << np.uint32(9)
        self.code |= within << np.uint32(5)
        self.code |= np.minimum(depth, np.uint32(DEPTHS - 1)) << np.uint32(1)
        self.code |= bit
        #: Number of slots of each view's table.
        self.slots = [1 << b for b in self.slot_bits]

    def index(self) -> words.Index:
        return words.Index(self.coded)

    def tokens(self, texts: list[list[bytes]], index: words.Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`of_words` for texts that are lists of words."""
        return self.of_words(words.Cut([b" ".join(t) for t in texts]), index)

    def of_words(self, found: words.Cut, index: words.Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of each token, ends included; the mixed contexts, a row for each view; where texts start; places in ``index``.

        ``index`` holds the coded words first, by their symbols; further words are escaped. Words outside it have
        negative places.
        """
        sizes = np.diff(found.first) + 1
        ends = np.cumsum(sizes) - 1
        at, n = ends + 1 - sizes, int(sizes.sum())
        inner = np.ones(n, bool)
        inner[ends] = False
        ident = np.full(n, self.end)
        ident[inner] = index.places(found)
        begin = np.repeat(at, sizes)
        first, second = at, at[ends > at] + 1
        symbol = np.where((ident < 0) | (ident >= len(self.coded)), self.escape, ident)
        symbol[ends] = self.end
        before, two = np.empty(n, np.int64), np.empty(n, np.int64)
        before[1:], two[2:] = symbol[:-1], symbol[:-2]
        before[first] = two[first] = two[second] = self.start
        same = np.zeros(n, bool)
        same[inner] = found.repeats()
        same[first] = False
        marked = np.maximum.accumulate(np.where(symbol < min(MARKERS, len(self.coded)), np.arange(n), -1))
        marker = np.full(n, self.start)
        marker[1:] = np.where(marked[:-1] >= begin[1:], symbol[marked[:-1]], self.start)
        marker[first] = self.start
        rows = [marker, before, (two << 32) | before]
        return np.where(same, self.copy, symbol), np.stack([words.mix(r.astype(_U) + s) for r, s in zip(rows, _VIEW_SALT)]), at, ident

    def bits(self, symbol: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The number of bits of each symbol's code; of each bit its depth and value, and its table slot for each view."""
        sizes, depth, bit, code = self.codes(symbol)
        return sizes, depth, bit, self.places(list(mixed), sizes, code, self.slot_bits)

    def codes(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of bits of each symbol's code; of each bit its depth, its value and its entry in ``code``."""
        begin = np.take(self.at, symbol)
        sizes = np.take(self.at, symbol + 1) - begin
        begin -= np.cumsum(sizes)
        begin += sizes
        flat = np.repeat(begin, sizes)
        flat += np.arange(len(flat))
        code = np.take(self.code, flat, mode="wrap")  # all are within; the mode spares a check
        return sizes, ((code >> np.uint32(1)) & np.uint32(15)).astype(np.uint8), (code & np.uint32(1)).astype(np.uint8), code

    def places(self, mixed: list[np.ndarray], sizes: np.ndarray, code: np.ndarray, slot_bits: list[int]) -> list[np.ndarray]:
        """Table slots for each of the contexts: that of the top of the bit's subtree, hashed with the context, turned by the bit's place within, so it stays in 16 slots side by side."""
        top = (code >> np.uint32(9)).astype(_U)
        top *= _C1
        within = ((code >> np.uint32(5)) & np.uint32(15)).astype(_U)
        out = []
        for m, bits in zip(mixed, slot_bits):
            slot = np.repeat(m, sizes)
            slot ^= top
            slot *= _C2
            slot >>= _U(64 - bits)
            slot ^= within
            out.append(slot.view(np.int64))
        return out


def _count_bits(tables: list[np.ndarray], coder: Coder, found: words.Cut, index: words.Index) -> None:
    """Add the zeros and ones of the bits of all symbols in their contexts."""
    symbols, contexts, _, _ = coder.of_words(found, index)
    new = coder.once[symbols]
    symbols, contexts = np.concatenate([symbols, np.full(int(new.sum()), coder.escape)]), np.concatenate([contexts, contexts[:, new]], axis=1)
    for i in range(0, len(symbols), PIECE):
        _, _, bit, place = coder.bits(symbols[i : i + PIECE], contexts[:, i : i + PIECE])
        one = np.ones(len(bit), np.int32)
        for t, p in zip(tables, place):
            p *= 2
            p += bit
            np.add.at(t, p, one)


def start_weights() -> np.ndarray:
    """Weights from which every text starts (input, gate): the longer a context that was seen, the more it counts."""
    # By whether the word before and the two words before were seen; inputs are the views and a bias.
    by_seen = np.array([[1.0, 0.0, 0.0, 0.0], [0.8, 0.0, 0.5, 0.0], [0.75, 0.35, 0.0, 0.0], [0.65, 0.5, 0.35, 0.0]], np.float32)
    return np.ascontiguousarray(np.tile(by_seen, (DEPTHS, 1)).T)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, int, words.Cut]]:
    """Words of consecutive texts of about ``limit`` bytes: batch, first row, words."""
    for batch in batches:
        for first, texts in words.chunks(batch.column(column), limit):
            yield batch, first, words.Cut(texts)


def _tables(docs: DataFrame, coder, index, n_tokens: int) -> list[np.ndarray]:
    """Stretched counts of the bits of all training texts (of ``n_tokens`` tokens), a table for each view."""
    sizes = coder.value.slots
    first = np.cumsum([0, *sizes]) // BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * n, np.int32) for n in sizes]
        for _, _, found in _chunks(batches, 0, CHUNK):
            _count_bits(tables, coder.value, found, index.value)
        for v, t in enumerate(tables):
            blocks = t.reshape(-1, 2 * BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            for i in range(0, len(used), 256):
                some = used[i : i + 256]
                packed = [blocks[k].astype(np.uint16 if blocks[k].max() < 1 << 16 else np.uint32).tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(first[v] + some, pa.int64()), pa.array(packed, pa.binary())], names=["block", "n"])

    def total_of(group: pa.Table) -> np.ndarray:
        total = np.zeros(2 * BLOCK, np.int64)
        for x in group.column("n"):
            x = x.as_py()
            total += np.frombuffer(x, {4: np.uint16, 8: np.uint32, 16: np.int64}[len(x) // BLOCK])
        return total

    def some(group: pa.Table) -> pa.Table:
        return pa.table({"block": group.column("block").slice(0, 1), "n": pa.array([total_of(group).tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = total_of(group)
        x = np.log((total[1::2] + 0.2) / (total[::2] + 0.2)).astype(np.float32)
        return pa.table({"block": group.column("block").slice(0, 1), "n": pa.array([x.tobytes()], pa.binary())})

    schema = "block long, n binary"
    tasks = max(8, n_tokens // TASK_TOKENS)
    counted = docs.where("_train").select("text").coalesce(tasks).mapInArrow(count, schema)
    if tasks > SUMMED:
        counted = counted.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(ceil(tasks / SUMMED)))).groupBy("block", "part").applyInArrow(some, schema)
    summed = counted.groupBy("block").applyInArrow(add, schema)
    stretched = np.zeros((first[-1], BLOCK), np.float32)
    for r in summed.toLocalIterator():  # tables of bounded size
        stretched[r["block"]] = np.frombuffer(bytes(r["n"]), np.float32)
    return [stretched[a:b].ravel() for a, b in zip(first[:-1], first[1:])]


def log10_coded(symbols: np.ndarray, contexts: np.ndarray, starts: np.ndarray, coder: Coder, stretched: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol's code; texts begin at ``starts``, and each learns by itself."""
    texts = len(starts)
    text = np.repeat(np.arange(texts), np.diff(np.append(starts, len(symbols))))
    place = np.arange(len(symbols)) - starts[text]
    stretch = np.searchsorted(STRETCHES, place, side="right")
    late = stretch == len(STRETCHES)
    stretch[late] += (place[late] - STRETCHES[-1]) // (STRETCHES[-1] - STRETCHES[-2])
    final = stretch == stretch[np.append(starts[1:], len(symbols)) - 1][text]  # nothing of these texts comes after, so they needn't learn
    key = 2 * stretch + final
    order = np.argsort(key, kind="stable")
    weights = np.ascontiguousarray(np.tile(start_weights(), (1, texts)).T)  # the four of a cell side by side, read at once
    came = np.zeros((texts * DEPTHS * REFINE, 2), np.float32)  # zeros and ones of each cell
    out = np.empty(len(symbols))
    for begin, end in _pieces(key[order], text[order]):
        those = order[begin:end]
        low, high = text[those[0]], text[those[-1]] + 1
        cells, seen_cells = weights[low * WORD_GATES : high * WORD_GATES], came[low * DEPTHS * REFINE : high * DEPTHS * REFINE]
        sizes, depth, bit, slot = coder.bits(symbols[those], contexts[:, those])
        x = [np.take(table, p, mode="wrap") for table, p in zip(stretched, slot)]  # all are within; the mode spares a check
        own = np.repeat((text[those] - low) * DEPTHS, sizes)
        own += depth
        g = own * 4
        g += ((x[1] != 0).view(np.uint8) << 1) | (x[2] != 0).view(np.uint8)
        w = np.take(cells.view(np.complex128)[:, 0], g, mode="wrap").view(np.float32).reshape(-1, VIEWS + 1)
        mixed = w[:, VIEWS] * np.float32(0.3)
        for i, row in enumerate(x):
            mixed += row * w[:, i]
        np.clip(mixed, -12, 12, out=mixed)
        p = 1 / (1 + np.exp(-mixed))
        np.clip(mixed, -8, 8, out=mixed)
        mixed *= 2
        mixed += np.float32(16.5)
        like = own
        like *= REFINE
        like += mixed.astype(np.uint8)
        seen = np.take(seen_cells.view(np.complex64)[:, 0], like, mode="wrap")
        fine = (seen.imag + np.float32(TRUST) * p) / (seen.real + seen.imag + np.float32(TRUST))
        fine += p
        fine *= np.float32(0.5)
        real = bit.astype(np.float32)
        fine += real
        fine -= 1
        chance = np.maximum(np.abs(fine, out=fine), np.float32(1e-9), out=fine)
        out[those] = np.add.reduceat(np.log(chance, out=chance).astype(np.float64), np.cumsum(sizes) - sizes) / log(10)
        if final[those[0]]:
            continue
        error = real - p
        n = np.bincount(g, minlength=len(cells)) + np.float32(INERTIA)
        for i, row in enumerate(x):
            cells[:, i] += RATE * np.bincount(g, row * error, len(cells)) / n
        cells[:, VIEWS] += RATE * 0.3 * np.bincount(g, error, len(cells)) / n
        like *= 2
        like += bit
        seen_cells += np.bincount(like, minlength=2 * len(seen_cells)).reshape(-1, 2)
    return out


def _pieces(key: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal ``key``, cut where a text ends once a piece has PIECE tokens: its arrays stay in a core's cache."""
    cuts = np.append(np.flatnonzero((np.diff(key) != 0) | (np.diff(text) != 0)) + 1, len(key)).tolist()
    begin = 0
    for cut in cuts:
        if cut - begin >= PIECE or cut == len(key) or key[cut] != key[begin]:
            yield begin, cut
            begin = cut


def _tail(found: words.Cut, text: np.ndarray, texts: int, rest: np.ndarray, fresh: np.ndarray) -> pa.Array:
    """For each text a list of its words in ``rest``, how often they are there (c), and how often ``fresh`` (s). A long word may be listed more than once."""
    some = np.flatnonzero(rest)
    some = some[np.lexsort((found.head[1][some], found.head[0][some], text[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (np.diff(text[some]) != 0) | (np.diff(found.head[:, some]) != 0).any(axis=0) | (found.sizes[some[1:]] > words.HELD) | (found.sizes[some[:-1]] > words.HELD)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(some)))
    spelled = np.add.reduceat(fresh[some].astype(np.int64), begin) if len(begin) else begin
    of_text = np.searchsorted(text[some[begin]], np.arange(texts + 1)).astype(np.int32)
    rows = pa.StructArray.from_arrays([found.listed(some[begin]), pa.array(count, pa.int64()), pa.array(spelled, pa.int64())], names=["word", "c", "s"])
    return pa.ListArray.from_arrays(pa.array(of_text), rows)


def _counted(docs: DataFrame) -> DataFrame:
    """kind 0: word, its training count n, its count m in all texts; 2: training texts."""

    def rows(found: pa.Array, n: np.ndarray, m: np.ndarray, kind: int = 0) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), found, pa.array(n), pa.array(m)], names=["kind", "word", "n", "m"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marked, size, texts = [], [], 0, 0
        trained, every = Counter(), Counter()  # of words that are told apart by more than their heads

        def flush() -> Iterator[pa.RecordBatch]:
            if size:
                yield rows(*words.short_counts(np.concatenate(held, axis=1), np.concatenate(marked)))
            if every:
                yield rows(pa.array(list(every), pa.binary()), np.array([trained[w] for w in every], np.int64), np.array(list(every.values()), np.int64))
            for x in (held, marked, trained, every):
                x.clear()

        for batch, first, found in _chunks(batches, 0, CHUNK):
            train = batch.column(1).slice(first, len(found.first) - 1).to_numpy(zero_copy_only=False).astype(bool)
            texts += int(train.sum())
            of_word = np.repeat(train, np.diff(found.first))
            short = found.sizes <= words.HELD
            for i in np.flatnonzero(~short).tolist():
                every[found.word(i)] += 1
                if of_word[i]:
                    trained[found.word(i)] += 1
            held.append(found.head[:, short])
            marked.append(of_word[short])
            size += len(marked[-1])
            if size >= POOL or len(every) > _FLUSH:
                yield from flush()
                size = 0
        yield from flush()
        yield rows(pa.array([b""], pa.binary()), np.array([texts], np.int64), np.zeros(1, np.int64), 2)

    partial = docs.select("text", "_train").mapInArrow(count, "kind int, word binary, n long, m long")
    return partial.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _least_count(vocabulary: DataFrame, count: str) -> int:
    """The least power of two such that no more than HEAD words have this many, or more, of ``count``."""
    sizes = {r["b"]: r["c"] for r in vocabulary.where(F.col(count) > 0).groupBy(F.floor(F.log2(count)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = 62, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= HEAD:
        least -= 1
        held += sizes.get(least, 0)
    return 1 << least


def score(docs: DataFrame, train) -> DataFrame:
    """doc_id, _train, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    ``train`` is a boolean column over ``docs`` (null: true) that says which texts are learned from. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a null text is empty and has one token, its end. base_score is the
    add-one unigram log10 probability; score the model's. Repeated rows each have a row; with no training
    text every count is 0 and base_score is 0. Further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("_train"))
    counted = scratch.table(_counted(docs), "words")
    vocabulary = counted.where("kind = 0").select("word", "n", "m")
    sums = vocabulary.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
    ends = sum(r["n"] for r in counted.where("kind > 0").collect())
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    tables = _count_tables(vocabulary.where("n > 0"), v)
    shared = spark.sparkContext.broadcast(tables)
    weights, refined = _weights(vocabulary.where("n = 1"), shared)
    spelling = spark.sparkContext.broadcast((stretched_counts(tables), weights, refined))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [log10_spelled(some, *spelling.value) for some in _batches(batch.column(0), 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found), pa.float64())], names=["word", "n", "m", "lp"])

    in_code = F.col("n") >= _least_count(vocabulary, "n")  # by training counts alone: held-out texts change no code
    near = in_code | (F.col("m") >= _least_count(vocabulary, "m"))  # whose counts are broadcast; this changes no score
    spelled = vocabulary.where(~in_code).mapInArrow(spell, "word binary, n long, m long, lp double")
    scored = scratch.table(vocabulary.where(in_code).withColumn("lp", F.lit(0.0)).unionByName(spelled), "scored")
    head = scored.where(near).select("word", "n", "lp", in_code.alias("coded")).toArrow()  # at most 2 * HEAD words
    names, counts, logs = head.column("word").to_pylist(), head.column("n").to_numpy(), head.column("lp").to_numpy()
    coded = sorted(((w, int(c)) for w, c, own in zip(names, counts, head.column("coded").to_pylist()) if own), key=lambda r: (-r[1], r[0]))
    known = np.array([c for _, c in coded], np.int64)
    slot_bits = max(LEAST_BITS, ceil(log2(16 * (v + 1))))
    escapes = n - ends - int(known.sum()) + int((known == 1).sum())
    coder = spark.sparkContext.broadcast(Coder([w for w, _ in coded], known, ends, escapes, slot_bits))
    order = {w: i for i, (w, _) in enumerate(coded)}
    place = np.array(sorted(range(len(names)), key=lambda i: (order.get(names[i], len(order)), names[i])), np.int64)  # coded words first
    index = spark.sparkContext.broadcast(words.Index([names[i] for i in place]))
    model = spark.sparkContext.broadcast(_tables(docs, coder, index, n))
    scratch.drop(counted)
    base_of = -log10(n + v + 1)
    end = (log10(ends + 1) + base_of, int(ends > 0))
    top = spark.sparkContext.broadcast((np.log10(counts[place] + 1.0) + base_of, counts[place] > 0, logs[place]))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stretched = coder.value, model.value
        base, known, logs = (np.append(x, 0.0) for x in top.value)  # the last is for words that meet their counts below
        for batch, first, found in _chunks(batches, 1, CHUNK):
            symbols, contexts, at, ident = own.of_words(found, index.value)
            lps = np.add.reduceat(log10_coded(symbols, contexts, at, own, stretched), at)
            texts = len(at)
            text = np.repeat(np.arange(texts), np.diff(found.first))
            inner = np.arange(len(found)) + text  # a word's token: each text before it has an end
            place, fresh = ident[inner], symbols[inner] == own.escape  # spelled here, not copied
            total = lambda x: np.bincount(text, x, texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, texts),
                    batch.column(2).slice(first, texts),
                    pa.array(np.diff(found.first) + 1, pa.int64()),
                    pa.array(total(base[place]) + end[0]),
                    pa.array(total(known[place]).astype(np.int64) + end[1]),
                    pa.array(lps + total(np.where(fresh, logs[place], 0.0))),
                    _tail(found, text, texts, place < 0, fresh),
                ],
                names=["doc_id", "_train", "n_tokens", "base", "known", "lp", "tail"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _train boolean, n_tokens long, base double, known long, lp double, tail array<struct<word: binary, c: long, s: long>>"
    rows = scratch.table(docs.mapInArrow(heads, schema).withColumn("_row", F.monotonically_increasing_id()), "heads")
    tail = rows.select("_row", F.explode("tail").alias("t")).select("_row", "t.word", "t.c", "t.s").join(scored.where(~near), "word")
    of_row = tail.groupBy("_row").agg(
        F.sum(F.col("c") * (F.log10(F.col("n") + 1.0) + F.lit(base_of))).alias("base2"), F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(0)).alias("known2"), F.sum(F.col("s") * F.col("lp")).alias("lp2")
    )
    return rows.drop("tail").join(of_row, "_row", "left").select(
        "doc_id",
        "_train",
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        (F.col("lp") + F.coalesce("lp2", F.lit(0.0))).alias("score"),
    )
