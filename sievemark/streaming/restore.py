"""Structured Streaming: restoring placeholders in responses that arrive in pieces, and rollups of the event log."""

from __future__ import annotations

import base64
import codecs
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import frames, json_spans
from ..functions import masking as M

# What may be the start of a placeholder at the end of a fragment, and the most bytes of it.
PARTIAL = re.compile(r"(?:\\{0,3}\{){1,3}\s{0,4}[A-Za-z0-9_]{0,20}\s{0,4}\\{0,3}\}?\\{0,3}\Z|\\{1,3}\Z|[A-Z0-9]{1,12}_[a-z0-9]{0,5}\Z")
HOLD = 48
#: Milliseconds without input after which a session ends: what is held is given out.
IDLE_MS = 600_000
#: Most fragments of a session that wait for one before them; beyond it that one is given up.
WAITING = 10_000


def held_back(text: str, final: bool) -> tuple[str, str]:
    """(what can be restored now, what may be the start of a placeholder)."""
    if not final and (m := PARTIAL.search(text)) and len(m[0].encode()) <= HOLD:
        return text[: m.start()], text[m.start() :]
    return text, ""


def feed(held: str, text: str, known: dict, final: bool, escape: bool = False) -> tuple[M.Restored, str]:
    """(restored, held back) after one more fragment of a channel."""
    now, later = held_back(held + text, final)
    return M.restored(now, known, escape), later


@dataclass
class Session:
    """What is kept of a stream between its pieces; only short strings."""

    following: int = 0
    waiting: dict[str, list] = field(default_factory=dict)
    tail: str = ""
    buffer: str = ""
    pending: dict[str, str] = field(default_factory=dict)
    templates: dict[str, str] = field(default_factory=dict)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0])
    samples: list[str] = field(default_factory=list)

    def decoded(self, data: bytes, final: bool) -> str:
        """Text of the bytes so far; up to three of a cut character wait."""
        if not self.tail:
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        whole = base64.b64decode(self.tail) + data
        text = decoder.decode(whole, final)
        self.tail = base64.b64encode(decoder.getstate()[0]).decode()
        return text

    def push(self, data: bytes, framing: str, known: dict, final: bool) -> str:
        """Restored frames that are whole now; at the end also the rest and all that channels hold."""
        text = self.decoded(data, final).replace("\r\n", "\n")
        if self.buffer.endswith("\r") and text.startswith("\n"):
            self.buffer = self.buffer[:-1]
        self.buffer += text
        cut = "\n" if framing == "ndjson" else "\n\n"
        *whole, self.buffer = self.buffer.split(cut)
        out = [self.frame(f, framing, known, False) + cut for f in whole]
        if 4 * len(self.buffer) > frames.EVENT_BYTES and len(self.buffer.encode()) > frames.EVENT_BYTES:
            error = '{"error":{"message":"single event exceeds 64 MiB"}}'
            out.append((f"data: {error}" if framing == "sse" else error) + cut)
            self.buffer = ""
        if final:
            if self.buffer:
                last, self.buffer = self.frame(self.buffer, framing, known, True), ""
                out.append(last if last.endswith(cut) else last + cut)
            out.append(self.flush(framing, known, None))
        return "".join(out)

    def count(self, one: M.Restored) -> str:
        if not (one.restored or one.unresolved):
            return one.text
        for i, n in enumerate((one.restored, one.degraded, one.unresolved)):
            self.counts[i] += n
        self.samples = list(dict.fromkeys([*self.samples, *one.samples]))[:5]
        return one.text

    def frame(self, frame: str, framing: str, known: dict, final: bool) -> str:
        if framing == "ndjson":
            return self.event(frame.strip(), framing, known, final) if frame.strip() else frame
        lines = frame.split("\n")
        if not (frame.startswith("data:") or any(x.lstrip().startswith("data:") for x in lines)):
            return frame if not frame.strip() else self.event(frame.strip(), framing, known, final, bare=True)
        out: list[str] = []
        for line in lines:
            if not line.startswith("data:"):
                out.append(line)
                continue
            payload = line.rstrip("\r")[5:].removeprefix(" ")
            if payload.strip() == "[DONE]":
                out += [*self._before(self.flush(framing, known, None)), line]
                continue
            before, _, shown = self.event(payload, framing, known, final).rpartition("\0")
            out += [*self._before(before), f"data: {shown}"]
        return "\n".join(out)

    @staticmethod
    def _before(flushed: str) -> list[str]:
        return ["", *flushed.rstrip("\n").split("\n"), ""] if flushed else []

    def event(self, text: str, framing: str, known: dict, final: bool, bare: bool = False) -> str:
        """One restored event; what ends with it and was held comes first (for sse up to a zero character)."""
        data = json_spans.loaded(text)
        if data is json_spans.INVALID:
            return self.count(M.restored(text, known))
        slots = [] if bare else frames.text_slots(data)
        over = frames.ends(data)
        if not slots:
            before = "" if bare or not isinstance(data, dict) else self._ended(over, framing, known)
            return before + self.count(json_spans.restored(text, known))
        if '"tool_calls"' in text or "\\u" in text:
            frames.merge_tool_calls(data)
            slots = frames.text_slots(data)
        for s in slots:
            last = final or over is None or any(s.channel.startswith(p) for p in over)
            one, later = feed(self.pending.pop(s.channel, ""), s.text, known, last, s.escape)
            frames.put(data, s.path, self.count(one))
            if later:
                self.pending[s.channel] = later
        compact = _COMPACT(data)
        for s in slots:
            if s.channel in self.pending:
                self.templates[s.channel] = compact
        before = "" if final else self._ended(over, framing, known)
        return before + self.count(json_spans.restored(compact, known))

    def _ended(self, over: list[str] | None, framing: str, known: dict) -> str:
        flushed = self.flush(framing, known, over) if over is None or over else ""
        return flushed + "\0" if flushed and framing == "sse" else flushed

    def flush(self, framing: str, known: dict, prefixes: list[str] | None) -> str:
        """What the channels hold, each in a copy of its last event."""
        out = []
        for channel in [c for c in self.pending if prefixes is None or any(c.startswith(p) for p in prefixes)]:
            left, template = self.pending.pop(channel), self.templates.pop(channel, None)
            data = json.loads(template) if template else None
            own = next((s for s in frames.text_slots(data) if s.channel == channel), None)
            text = self.count(M.restored(left, known, bool(own and own.escape)))
            if own:
                for s in frames.text_slots(data):
                    frames.put(data, s.path, text if s.channel == channel else "")
                for choice in data.get("choices") or []:
                    choice["finish_reason"] = None
                if "done" in data:
                    data["done"] = False
            else:
                data = {"text": text}
            body = _COMPACT(data)
            named = f"event: {data['type']}\n" if isinstance(data.get("type"), str) else ""
            out.append(f"{body}\n" if framing == "ndjson" else f"{named}data: {body}\n\n")
        return "".join(out)


_COMPACT = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def by_suffix(known: dict[str, str] | None) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for token, value in (known or {}).items():
        out.setdefault(token[-8:-2], {})[token] = value
    return out


def _in_order(session: Session, batches: Iterator[pd.DataFrame], columns: list[str]) -> tuple[list[tuple], dict, str]:
    """Fragments whose turn has come, the session's tokens and its framing; others wait in the session."""
    last, framing = None, "sse"
    for batch in batches:
        last = next((k for k in reversed(batch["known"].tolist()) if isinstance(k, str)), last)
        framing = batch["framing"].iloc[-1] if "framing" in batch.columns and len(batch) else framing
        for seq, *values in zip(batch["seq"].tolist(), *(batch[c].tolist() for c in columns)):
            if seq >= session.following:
                session.waiting[str(int(seq))] = values
    ready = []
    while session.waiting and (str(session.following) in session.waiting or len(session.waiting) > WAITING):
        if str(session.following) in session.waiting:
            ready.append((session.following, *session.waiting.pop(str(session.following))))
        session.following += 1
    return ready, by_suffix(json.loads(last) if last is not None else {}), framing


def _with_known(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each fragment with the tokens of its session (sid, known: map of token to value) as JSON, of which only the last one is read; joined anew for each batch of a stream."""
    return chunks.join(sessions.select("sid", F.to_json("known").alias("known")), "sid", "left")


OUT = "sid string, channel string, seq long, text string, restored long, unresolved long"
STATE = "session string, known string, framing string"


def restore_stream(chunks: DataFrame, sessions: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Restore placeholders in a stream of (sid, channel, seq, text, final) fragments.

    A placeholder may be cut anywhere between fragments: its start is held back until the next one. Fragments may come out of
    order; they wait until the sequence from 0 has no gap. ``sessions`` (sid, known: map of token to value) is joined to each
    batch, so tokens that are issued later are known. State ends with the final fragment, or without input for
    ``idle_ms``: what is held comes then, with the next number. With None state waits for the final fragment, as it must
    where a trigger ends with the data. Equal to restoring the joined text of each channel.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, known, _ = _loaded(state)
        out = []
        if state.hasTimedOut:
            one = M.restored(session.pending.pop("", ""), known)
            out.append((*key, session.following, one.text, one.restored, one.unresolved))
            state.remove()
        else:
            ready, found, _ = _in_order(session, batches, ["text", "final"])
            known, over = found or known, False
            for seq, text, final in ready:
                one, later = feed(session.pending.pop("", ""), text or "", known, bool(final))
                session.pending = {"": later} if later else {}
                out.append((*key, seq, one.text, one.restored, one.unresolved))
                over = over or bool(final)
            _keep(state, session, known, "", over, idle_ms)
        yield pd.DataFrame(out, columns=["sid", "channel", "seq", "text", "restored", "unresolved"])

    return _with_known(chunks, sessions).groupBy("sid", "channel").applyInPandasWithState(step, OUT, STATE, "append", _timeout(idle_ms))


FRAMES_OUT = "sid string, seq long, text string, restored long, degraded long, unresolved long"


def restore_frames(chunks: DataFrame, sessions: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Restore placeholders in a stream of (sid, seq, framing, chunk, final): bytes of server-sent events or lines of JSON.

    Characters, frames and placeholders may be cut anywhere. Texts of one channel are restored together over its events;
    when an event ends a channel, and at the end, what is held comes first in a copy of the channel's last event. Counts
    are those of the piece. State as of ``restore_stream``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, known, framing = _loaded(state)
        out = []
        if state.hasTimedOut:
            out.append((*key, session.following, session.push(b"", framing, known, True), *session.counts))
            state.remove()
        else:
            ready, found, named = _in_order(session, batches, ["chunk", "final"])
            known, framing, over = found or known, named or framing, False
            for seq, chunk, final in ready:
                session.counts = [0, 0, 0]
                text = session.push(chunk or b"", framing, known, bool(final))
                out.append((*key, seq, text, *session.counts))
                over = over or bool(final)
            _keep(state, session, known, framing, over, idle_ms)
        yield pd.DataFrame(out, columns=["sid", "seq", "text", "restored", "degraded", "unresolved"])

    return _with_known(chunks, sessions).groupBy("sid").applyInPandasWithState(step, FRAMES_OUT, STATE, "append", _timeout(idle_ms))


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _loaded(state: GroupState) -> tuple[Session, dict, str]:
    if not state.exists:
        return Session(), {}, "sse"
    loaded, known, framing = state.get
    session = Session(**json.loads(loaded))
    if framing:  # chunks of frames, which are bytes
        session.waiting = {k: [base64.b64decode(v[0] or ""), *v[1:]] for k, v in session.waiting.items()}
    return session, json.loads(known), framing


def _keep(state: GroupState, session: Session, known: dict, framing: str, over: bool, idle_ms: int | None) -> None:
    if over:
        if state.exists:
            state.remove()
        return
    session.waiting = {k: [base64.b64encode(v).decode() if isinstance(v, bytes | bytearray) else v for v in values] for k, values in session.waiting.items()}
    state.update((json.dumps(asdict(session)), json.dumps(known), framing))
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)


def daily_rollup(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming counts of events by day and type; a day closes when the watermark has passed it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n", "total")


def append_with_rollups(events: DataFrame, log_path: str, rollup_path: str, checkpoint: str):
    """Append each micro-batch to the log and its partial counts to the rollup; a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number))
        for frame, path in ((batch, log_path), (batch.groupBy("batch", F.to_date("ts").alias("day"), "event_type").count(), rollup_path)):
            frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
