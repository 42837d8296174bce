"""Rewriting by patterns in a text that arrives in pieces: what no later piece can change goes out, the rest is held.

A rule's stage holds a text from the first position at which a match is open: the text from there on is a match that may
still grow, or the beginning of one (partial matching of the ``regex`` package tells). Stages follow each other as the rules do
on a whole text, each on what the one before it let out, so the pieces that come out join to the rewritten whole. Only what is
longer than the limit of bytes that a stage may hold is let go before it is decided.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import regex

from . import patterns as P

# Fixed value: bytes that a stage may hold.
HOLD = 64
#: Characters before a position that patterns look back at.
BEFORE = 4


@dataclass(frozen=True)
class Hit:
    id: str
    label: str
    snippet: str


def snippet(match: str) -> str:
    return match.strip(" \t\n\r\x0b\x0c")[: P.SNIPPET]


class Stage:
    """One rule. The state of a text is (what was before, what is held), two short strings."""

    def __init__(self, id_: str, label: str, pattern: str, hold: int = HOLD):
        self.id, self.label, self.hold = id_, label, hold
        self.pattern = regex.compile(pattern.replace(r"\z", r"\Z"))

    def feed(self, state: list[str], text: str, final: bool, counts: Callable[[Hit], bool], notice: str | None) -> tuple[str, list[Hit]]:
        """(what goes out, hits that ``counts`` lets count); ``state`` is changed. Without a notice matches stay as they are."""
        buffer = state[0] + state[1] + text
        at, out, hits = len(state[0]), [], []
        least = at if final else self._within(buffer, at)
        first = None if final else self._open(buffer, max(at, least))
        while True:
            m = self.pattern.search(buffer, at)
            if first is not None and first < at:
                first = self._open(buffer, max(at, least))
            if not m or (first is not None and first <= m.start()):
                break
            out.append(buffer[at : m.start()])
            hit = Hit(self.id, self.label, snippet(m[0]))
            if counts(hit):
                hits.append(hit)
                out.append(m[0] if notice is None else notice)
            else:
                out.append(m[0])
            at = max(m.end(), at + (m.end() == m.start()))
        stop = len(buffer) if first is None else max(first, at)
        out.append(buffer[at:stop])
        state[:] = [buffer[max(0, stop - BEFORE) : stop], buffer[stop:]]
        return "".join(out), hits

    def opens(self, before: str, text: str, final: bool) -> bool:
        """Whether a piece has a match, or the beginning of one, where nothing is held."""
        m = self.pattern.search(before + text, len(before), partial=not final)
        return m is not None and not (m.partial and m.start() == len(before + text))

    def _within(self, buffer: str, at: int) -> int:
        """The first position from which no more than the limit is left."""
        if buffer.isascii():
            return max(at, len(buffer) - self.hold)
        size, i = 0, len(buffer)
        while i > at and size + len(buffer[i - 1].encode()) <= self.hold:
            i -= 1
            size += len(buffer[i].encode())
        return i

    def _open(self, buffer: str, at: int) -> int | None:
        """The first position from ``at`` on whose rest is a match or the beginning of one."""
        m = self.pattern.search(buffer, at, partial=True)
        if m is None:
            return None
        if m.partial:
            return m.start() if m.start() < len(buffer) else None
        return next((s for s in range(at, len(buffer)) if self.pattern.fullmatch(buffer, s, partial=True)), None)


class Guard:
    """All rules after each other, for the texts of one session's channels."""

    def __init__(self, rules: list[tuple[str, str, str]] | None = None, allow: tuple[str, ...] = (), hold: int = HOLD, notice: str = P.NOTICE):
        self.stages = [Stage(*r, hold) for r in (P.COMMANDS if rules is None else rules)]
        scoped = [f"(?i:{s.pattern.pattern[4:]})" if s.pattern.pattern.startswith("(?i)") else f"(?:{s.pattern.pattern})" for s in self.stages]
        self.any = regex.compile("|".join(scoped)) if scoped else None
        self.allow = [regex.compile(a) for a in allow]
        self.notice = notice

    def feed(self, states: list[list[str]], text: str, final: bool, echoes: frozenset[str] | set[str] = frozenset(), rewrite: bool = True) -> tuple[str, list[Hit]]:
        """One more piece of a channel through all stages; ``states`` (empty at first) is changed. Hits come in the order of rules."""
        if not states:
            states += [["", ""] for _ in self.stages]
        if not any(held for _, held in states) and not any(self._opens(before, text, final) for before in {b for b, _ in states}):
            for state in states:
                state[0] = (state[0] + text)[-BEFORE:]
            return text, []
        found: list[Hit] = []
        counts = lambda h: h.snippet != "" and h.snippet not in echoes and not any(a.search(h.snippet) for a in self.allow)
        for stage, state in zip(self.stages, states):
            if not state[1] and not stage.opens(state[0], text, final):
                state[0] = (state[0] + text)[-BEFORE:]
                continue
            text, hits = stage.feed(state, text, final, counts, self.notice if rewrite else None)
            found += hits
        return text, found

    def _opens(self, before: str, text: str, final: bool) -> bool:
        """Whether any rule has a match, or the beginning of one, in a piece: one search where most pieces have none."""
        m = self.any.search(before + text, len(before), partial=not final) if self.any else None
        return m is not None and m.start() < len(before + text)
