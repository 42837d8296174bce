"""Dangerous commands in responses that arrive in pieces: found across pieces, rewritten or stopped before they go out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions import patterns as P
from ..functions.transducers import HOLD, Guard, Hit
from ..operators.commands import Rules
from ..operators.ordered import carried
from .restore import IDLE_MS, WAITING, _timeout

# Fixed value: channels of a session that may hold text; those beyond it are judged piece by piece.
CHANNELS = 256
OUT = "sid string, channel string, seq long, kind string, text string, blocked boolean, hits array<struct<id: string, label: string, snippet: string>>"
_COLUMNS = ["sid", "channel", "seq", "kind", "text", "blocked", "hits"]
JOINED = "sid string, text string, hit boolean"


@lru_cache(4096)
def kind_of(channel: str) -> str:
    """tool, text or reason, as ``operators.commands.channel_kind``."""
    low = channel.lower()
    both = (low, low.replace(".x", "."))
    if any(c.rpartition(".")[2] in P.META_KEYS or any(m in c for m in P.TOOL_OUTPUTS) for c in both):
        return "text"
    if any(m in c for c in both for m in P.REASON_MARKS):
        return "reason"
    tool = any(tail == "" or tail[0].isdigit() for c in both for tail in c.split(".tool")[1:])
    return "tool" if tool or any(m in c for c in both for m in P.TOOL_MARKS) else "text"


@dataclass
class Session:
    """What is kept of a session between its pieces: short strings for each rule and open channel."""

    following: int = 0
    waiting: dict[str, list] = field(default_factory=dict)
    states: dict[str, list[list[str]]] = field(default_factory=dict)
    blocked: bool = False

    def piece(self, guard: Guard, how: "How", channel: str, text: str, final: bool, echoes: set[str]) -> tuple[str, str, bool, list[Hit]]:
        """kind, what goes out, whether it is stopped, and the hits of one piece."""
        kind = kind_of(channel)
        if kind != "reason" and kind not in how.channels:
            return kind, text, False, []
        if self.blocked and kind != "reason":
            return kind, "", True, []
        states = self.states.pop(channel, [])
        watched = kind == "reason" or how.mode == "observe"
        alone = final or (not states and len(self.states) >= CHANNELS)
        out, hits = guard.feed(states, text, alone, set() if kind == "reason" else echoes, not watched)
        if not alone:
            self.states[channel] = states
        if watched:
            return kind, text, False, hits
        if how.mode == "block" and hits:
            self.blocked, self.states = True, {}
            return kind, "", True, hits
        return kind, out, False, hits

    def rest(self, guard: Guard, how: "How", echoes: set[str]) -> list[tuple[str, str, str, bool, list[Hit]]]:
        """What the channels still hold, at the end of the session."""
        return [(c, *self.piece(guard, how, c, "", True, echoes)) for c in list(self.states)]


@dataclass(frozen=True)
class How:
    """mode: observe (all goes on), rewrite (a notice in the place of commands) or block (nothing goes on from the piece of a hit on)."""

    mode: str = "rewrite"
    channels: tuple[str, ...] = ("tool",)
    rules: Rules | None = None
    allow: tuple[str, ...] = ()
    hold: int = HOLD

    def guard(self) -> Guard:
        return Guard(self.rules, self.allow, self.hold)


def _hits(found: list[Hit]) -> list[dict]:
    return [asdict(h) for h in found]


def guard_stream(pieces: DataFrame, how: How = How(), echoes: DataFrame | None = None, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Judge a stream of (sid, channel, seq, text, final) pieces; seq counts a session's pieces from 0, over all its channels.

    Texts of a channel join to the rewritten whole wherever they are cut (see ``transducers``; a stage holds ``how.hold``
    bytes at most). Mode block ends all judged channels of the session with the first hit: that piece and all after it come out
    empty; hits of the reason kind are told but change nothing. ``echoes`` (sid, snippets: array of what the request holds
    itself) is joined to each batch; such commands are no hits. Pieces may come out of order. State ends without input for
    ``idle_ms``: what channels without a final piece hold comes then, with the next numbers.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = how.guard()
        session, known = Session(), set()
        if state.exists:
            kept, own = state.get
            session, known = Session(**json.loads(kept)), set(json.loads(own))
        out = []
        if state.hasTimedOut:
            for i, (channel, kind, text, stopped, hits) in enumerate(session.rest(guard, how, known)):
                out.append((*key, channel, session.following + i, kind, text, stopped, _hits(hits)))
            state.remove()
        else:
            for batch in batches:
                for r in batch.itertuples():
                    if getattr(r, "snippets", None) is not None:
                        known |= set(r.snippets)
                    if r.seq >= session.following:
                        session.waiting[str(int(r.seq))] = [r.channel, r.text or "", bool(r.final)]
            while session.waiting and (str(session.following) in session.waiting or len(session.waiting) > WAITING):
                if piece := session.waiting.pop(str(session.following), None):
                    kind, text, stopped, hits = session.piece(guard, how, *piece, known)
                    out.append((*key, piece[0], session.following, kind, text, stopped, _hits(hits)))
                session.following += 1
            state.update((json.dumps(asdict(session)), json.dumps(sorted(known))))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=_COLUMNS)

    rows = pieces if echoes is None else pieces.join(echoes.select("sid", "snippets"), "sid", "left")
    return rows.groupBy("sid").applyInPandasWithState(step, OUT, "session string, known string", "append", _timeout(idle_ms))


def guard_pieces(pieces: DataFrame, how: How = How(), echoes: DataFrame | None = None, joined: bool = False) -> DataFrame:
    """``guard_stream`` over a table: the sessions' pieces in order, a short carry from one to the next.

    Sessions are sorted within partitions, never gathered: a session of any length passes row by row. With ``joined`` what goes
    out of a session is joined where it was judged, in one row (sid, text, and whether any piece has a hit), so that no one
    needs to bring its pieces together once more.
    """
    rows = pieces if echoes is None else pieces.join(echoes.select("sid", "snippets"), "sid", "left")
    rows = rows.select("sid", "channel", "seq", "text", "final", *([] if echoes is None else ["snippets"]))
    if joined:
        return carried(rows, lambda: _joined(_walk(how)), JOINED)
    return carried(rows, lambda: _walk(how), OUT)


def _joined(one: Callable) -> Callable:
    """``one`` with all that comes out of a session as one row at its end; pieces of the same seq go by their text."""
    whole, same = StringIO(), []
    sid, seq, hit = None, None, False

    def joined(r) -> list[tuple]:
        nonlocal sid, seq, hit
        for sid, _, n, _, text, _, hits in one(r):
            if n != seq:
                whole.write("".join(sorted(same)))
                same.clear()
                seq = n
            same.append(text)
            hit = hit or bool(hits)
        if r is not None:
            return []
        whole.write("".join(sorted(same)))
        return [(sid, whole.getvalue(), hit)]

    return joined


def _walk(how: How) -> Callable:
    guard, session = how.guard(), Session()
    seen: dict = {"known": set(), "sid": None, "seq": -1}

    def one(r) -> list[tuple]:
        if r is None:
            rest = enumerate(session.rest(guard, how, seen["known"]), 1)
            return [(seen["sid"], channel, seen["seq"] + i, kind, text, stopped, _hits(hits)) for i, (channel, kind, text, stopped, hits) in rest]
        if getattr(r, "snippets", None) is not None:
            seen["known"] |= set(r.snippets)
        seen["sid"], seen["seq"] = r.sid, r.seq
        kind, text, stopped, hits = session.piece(guard, how, r.channel, r.text or "", bool(r.final), seen["known"])
        return [(r.sid, r.channel, r.seq, kind, text, stopped, _hits(hits))]

    return one


def left_over(hits: DataFrame) -> DataFrame:
    """sid, channel and snippet of commands in reason channels of judged pieces: what findings are compared with (see ``signals.without_reasoning``)."""
    flat = hits.where("kind = 'reason'").select("sid", "channel", F.explode("hits").alias("h"))
    return flat.select("sid", "channel", "h.snippet").distinct()
