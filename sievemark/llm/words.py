"""Words and word shingles of many texts at once, as 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A word's hash is a polynomial of its bytes modulo 2**64,
taken from running sums over the whole buffer, then mixed; no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text worked on at a time; longer texts are worked on whole.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256)
    lower[65:91] += 32
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return mix((lower.astype(_U) + _U(1)) * _U(_BASE)), white


_BYTES, _WHITE = _byte_table()
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words start (one more entry for the end)."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    n = len(buffer)
    if n == 0:
        return np.empty(0, _U), np.zeros(len(texts) + 1, np.int64)
    power, inverse = _power(n)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTES[buffer] * power[:n], out=sums[1:])
    edge = np.diff(_WHITE[buffer].view(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    found = mix((sums[ends] - sums[starts]) * inverse[starts])
    return found, np.searchsorted(starts, at)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words of one sequence; empty if it is shorter."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    if width <= 8:
        acc = words[:n].copy()
        for k in range(1, width):
            acc *= _U(_BASE)
            acc += words[k : k + n]
        return mix(acc)
    power, inverse = _power(len(words) + 1)
    sums = np.empty(len(words) + 1, _U)
    sums[0] = 0
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * inverse[:n] + _U(width))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the shingles of one text in order, with repeats; a shorter text is one shingle."""
    if 0 < len(words) < width:
        return windows(words, len(words))
    return windows(words, width)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """A string column's texts (null: empty) in runs of about ``limit`` bytes, with the first one's row."""
    held, first, size = [], 0, 0
    for i, x in enumerate(column.cast(pa.binary())):
        x = x.as_py() or b""
        if held and size + len(x) > limit:
            yield first, held
            held, first, size = [], i, 0
        held.append(x)
        size += len(x)
    if held:
        yield first, held


#: Bytes of a word that are held as two numbers.
HELD = 16
_SPACES = _U(0x2020202020202020)
_INSIDE = np.array([[(1 << 8 * min(max(n - k, 0), 8)) - 1 for n in range(HELD + 1)] for k in (0, 8)], _U)


class Cut:
    """Words of many texts, cut in one buffer: where they start, their sizes, and the first word of each text (one more entry for the end).

    ``head`` holds each word's first 16 bytes in two numbers, filled up with spaces, which are in no word: they tell
    words of up to 16 bytes apart for sure. No word becomes a Python object.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        joined = b" ".join([b"", *texts, b" " * 24]).lower()
        self.bytes = joined[: len(joined) & -8]  # whole numbers, and at least 16 bytes after the last word
        self.buffer = np.frombuffer(self.bytes, np.uint8)
        white = ((self.buffer - np.uint8(9)) < 5) | (self.buffer == 32)
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.starts, self.sizes = edges[::2], edges[1::2] - edges[::2]
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]) + 1)
        whole, at = np.frombuffer(self.bytes, "<u8"), self.starts >> 3
        right = ((self.starts & 7) << 3).astype(_U)
        left = _U(63) - right
        a, b, c = (whole[at + k] for k in range(3))
        held = np.minimum(self.sizes, HELD)
        self.head = np.stack([_SPACES ^ ((((x >> right) | ((y << _U(1)) << left)) ^ _SPACES) & inside[held]) for x, y, inside in ((a, b, _INSIDE[0]), (b, c, _INSIDE[1]))])

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.starts[i] + self.sizes[i]]

    def hashes(self) -> np.ndarray:
        """A hash of each word's first 16 bytes."""
        return _hashed(self.head)

    def repeats(self) -> np.ndarray:
        """Whether each word is the one before again, whichever text that is in."""
        same = np.zeros(len(self), bool)
        same[1:] = (self.head[0][1:] == self.head[0][:-1]) & (self.head[1][1:] == self.head[1][:-1]) & (self.sizes[1:] == self.sizes[:-1])
        for i in np.flatnonzero(same & (self.sizes > HELD)).tolist():
            same[i] = self.word(i) == self.word(i - 1)
        return same

    def listed(self, some: np.ndarray) -> pa.Array:
        """The words at the places ``some``, as a binary array."""
        ends = np.cumsum(self.sizes[some])
        begin = ends - self.sizes[some]
        data = self.buffer[np.repeat(self.starts[some] - begin, self.sizes[some]) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])
        return pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _hashed(head: np.ndarray) -> np.ndarray:
    x = head[0] * _U(_BASE) + head[1] * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)


def short_counts(head: np.ndarray, marked: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of up to 16 bytes, by their heads: each once (or, where hashes meet, more often), the number of those marked, and of all."""
    n = head.shape[1]
    if n == 0:
        return pa.array([], pa.binary()), np.empty(0, np.int64), np.empty(0, np.int64)
    low = _U((1 << n.bit_length()) - 1)
    key = _hashed(head)
    key &= ~low
    key |= np.arange(n, dtype=_U)
    key.sort()
    key &= low
    at = key.view(np.int64)
    a, b = head[0][at], head[1][at]
    new = np.ones(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    letters = np.stack([a[begin], b[begin]], axis=1).view(np.uint8)
    inside = letters != 32
    ends = np.cumsum(inside.sum(axis=1))
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(letters[inside])])
    return words, np.add.reduceat(marked[at].astype(np.int64), begin), np.diff(begin, append=n)


class Index:
    """Places of words in a list without repeats: an open table of hashes for those of up to 16 bytes, a dict for longer ones."""

    def __init__(self, some: list[bytes]):
        found = Cut([b" ".join(some)])
        long = found.sizes > HELD
        self.long = {some[i]: i for i in np.flatnonzero(long).tolist()}
        self.head = np.ascontiguousarray(found.head.T)
        self.bits = max(4, (2 * len(some)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.flatnonzero(~long).astype(np.int32), self._slots(found.hashes())[~long]
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - self.bits)).view(np.int64)

    def places(self, found: Cut) -> np.ndarray:
        """Place of each word, -1 for those that are not in the list."""
        out = np.full(len(found), -1, np.int64)
        left, slot, head = None, self._slots(found.hashes()), found.head
        while len(self.head) and (left is None or len(left)):
            at = np.take(self.table, slot, mode="wrap")  # all are within; the mode spares a check
            held = np.take(self.head.view(np.complex128)[:, 0], at, mode="clip").view(_U)
            equal, used = held[::2] == head[0], at >= 0
            equal &= held[1::2] == head[1]
            equal &= used
            out[equal if left is None else left[equal]] = at[equal]
            on = np.flatnonzero(used & ~equal)
            left, slot, head = on if left is None else left[on], (slot[on] + 1) & (len(self.table) - 1), head[:, on]
        for i in np.flatnonzero(found.sizes > HELD).tolist():
            out[i] = self.long.get(found.word(i), -1)
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
