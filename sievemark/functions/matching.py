"""Spans of user patterns and of dictionary words in one text, in time proportional to the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed value: longest dictionary word.
WORD_CHARS = 200
#: Seconds that a pattern which needs backtracking may take on one text.
PATIENCE_S = 2.0
_WORD, _SPACE = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}", r"\t-\r \x{85}\p{Z}"
_SHORT = {"d": r"\p{Nd}", "w": _WORD, "s": _SPACE}


def _unicode(pattern: str) -> tuple[str, bool] | None:
    """The pattern with \\d, \\w and \\s as Unicode classes for an engine that takes them as ASCII, and whether it asks for word borders; None if it can't be said so."""
    out, borders, within, i = [], False, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            i += 2
            if e in "dws":
                out.append(_SHORT[e] if within else f"[{_SHORT[e]}]")
            elif e in "DWS":
                if within:
                    return None
                out.append(f"[^{_SHORT[e.lower()]}]")
            elif e in "bB":
                if within:
                    return None
                borders = True
                out.append("\\" + e)
            elif e in "zZ":
                out.append(r"\z")
            elif e == "u" and re.fullmatch("[0-9A-Fa-f]{4}", pattern[i : i + 4]):
                out.append(r"\x{%s}" % pattern[i : i + 4])
                i += 4
            else:
                out.append("\\" + e)
            continue
        if c == "[" and not within:
            within = True
            out.append(c)
            i += 1
            for first in "^]":
                if pattern[i : i + 1] == first:
                    out.append("\\]" if first == "]" else first)
                    i += 1
            continue
        if c == "]":
            within = False
        out.append(c)
        i += 1
    return "".join(out), borders


class Pattern:
    """A user's pattern. ``find`` gives (start, end) of its matches from left to right; empty ones are none.

    Patterns of an automaton's kind run on one (RE2, by Arrow's kernels): time grows with the text alone, whatever the pattern.
    Those with look-around or back references, and word borders in texts beyond ASCII, need backtracking: they get
    ``PATIENCE_S`` seconds a text, after which what they found so far counts. A pattern that neither engine takes raises ValueError.
    """

    def __init__(self, pattern: str):
        self.linear, self.borders = None, False
        said = _unicode(pattern)
        if said:
            try:
                pc.match_substring_regex(pa.array([""]), pattern=said[0])
                self.linear, self.borders = said
            except pa.ArrowInvalid:
                pass
        try:
            self.slow = regex.compile(pattern)
        except regex.error:
            self.slow = None
            if self.linear is None:
                raise ValueError(f"no pattern: {pattern}") from None

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        if self.linear is not None and (self.slow is None or not self.borders or text.isascii()):
            yield from self._marked(text)
            return
        try:
            for m in self.slow.finditer(text, timeout=PATIENCE_S):
                if m[0]:
                    yield m.span()
        except TimeoutError:
            return

    def _marked(self, text: str) -> Iterator[tuple[int, int]]:
        """Matches put between two signs that the text hasn't got, then read off."""
        a, b = (c for c, _ in zip((c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text), "ab"))
        marked = pc.replace_substring_regex(pa.array([text]), pattern=self.linear, replacement=f"{a}\\0{b}")[0].as_py()
        first, *pieces = marked.split(a)
        at = len(first)
        for piece in pieces:
            inside, _, after = piece.partition(b)
            if inside:
                yield at, at + len(inside)
            at += len(inside) + len(after)


class Dictionary:
    """Many words. ``find`` gives (start, end, word) from left to right, the longest word first, none over another.

    Flat tables by the first one, two or three characters tell at which positions of a text a word may begin, all at once;
    only there, words are looked up by their lengths (200 at most). So time depends on the text, not on how many words there are.
    """

    BITS = 20

    def __init__(self, words: list[str]):
        self.words = {w for w in words if 0 < len(w) <= WORD_CHARS}
        self.sizes: dict[str, list[int]] = {}
        for w in self.words:
            self.sizes.setdefault(w[:3], []).append(len(w))
        self.sizes = {k: sorted(set(v), reverse=True) for k, v in self.sizes.items()}
        self.tables: dict[int, np.ndarray] = {}
        for head in self.sizes:
            table = self.tables.setdefault(len(head), np.zeros(1 << self.BITS, bool))
            table[self._cells(self._points(head), len(head))] = True

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def _cells(self, points: np.ndarray, size: int) -> np.ndarray:
        n = len(points) - size + 1
        key = np.zeros(max(n, 0), np.uint64)
        for j in range(size if n > 0 else 0):
            key = key * np.uint64(1 << 21) + points[j : j + n]
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def find(self, text: str) -> Iterator[tuple[int, int, str]]:
        points = self._points(text)
        may = np.zeros(len(points), bool)
        for size, table in self.tables.items():
            if len(points) >= size:
                may[: len(points) - size + 1] |= table[self._cells(points, size)]
        end = 0
        for at in np.flatnonzero(may).tolist():
            if at < end:
                continue
            for size in (3, 2, 1):
                found = next((text[at : at + n] for n in self.sizes.get(text[at : at + size], ()) if text[at : at + n] in self.words and at + n <= len(text)), None) if size in self.tables else None
                if found:
                    end = at + len(found)
                    yield at, end, found
                    break

