"""JSON bodies as rows: leaves, protocol, dialog, usage, models, slots, and embedded files. Parsing runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blobs, frames, json_spans
from .tables import sliced


def _each(rows: DataFrame, column: str, key: str, schema: str, make: Callable[[str], Any]) -> DataFrame:
    """``key`` and the columns of ``schema`` for all that ``make`` gives for each value of ``column`` (null: nothing)."""
    kind = rows.schema[key].dataType.simpleString()
    full = f"{key} {kind}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    for row in make(text):
                        at.append(i)
                        out.append(row)
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[c.split()[1]] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=[key, *names])

    return rows.select(key, column).mapInArrow(run, full)


LEAVES = "ord long, kind string, path array<string>, key string, parent string, depth int, value string, start long, stop long, in_business boolean, exempt boolean"


def leaves(bodies: DataFrame, body: str = "body", key: str = "row_id") -> DataFrame:
    """One row for each key and leaf of each JSON body, in order, with its place in the text; lists are transparent.

    kind is key, string, number, bool or null; exempt says whether masking leaves it alone. Bodies that are no JSON, and null
    ones, have none; repeated keys are all there.
    """

    def make(text: str):
        if not json_spans.valid(text):
            return
        for i, s in enumerate(json_spans.spans(text)):
            free = s.value in json_spans.PROTECTED_NAMES if s.kind == "key" else json_spans.exempt(s) or bool(s.kind == "string" and blobs.kind(s.value))
            yield i, s.kind, list(s.path), s.key, s.parent, s.depth, s.value, s.start, s.end, json_spans.in_business(s.path), free

    return _each(bodies, body, key, LEAVES, make)


def described(bodies: DataFrame, body: str = "body", path: str = "", key: str = "row_id") -> DataFrame:
    """protocol, model, stream, first_user, dialog, n_blobs and blob_bytes of each request body; nothing for what is no JSON."""

    def make(text: str):
        if not json_spans.valid(text):
            return
        data = frames.loads(text)
        get = data.get if isinstance(data, dict) else lambda _: None
        messages = get("messages") if isinstance(get("messages"), list) else []
        first = next((m.get("content") for m in messages if isinstance(m, dict) and m.get("role") == "user"), None)
        _, found, size = blobs.taken_out(text)
        model = get("model") if isinstance(get("model"), str) else ""
        yield frames.protocol(path, data), model, get("stream") is True, first if isinstance(first, str) else None, frames.dialog(data), len(found), size

    return _each(bodies, body, key, "protocol string, model string, stream boolean, first_user string, dialog string, n_blobs long, blob_bytes long", make)


def usage(bodies: DataFrame, body: str = "body", key: str = "row_id") -> DataFrame:
    """prompt, completion and model of each response body, whole or streamed."""
    return _each(bodies, body, key, "prompt long, completion long, model string", lambda text: [(*frames.usage_of_body(text), frames.model_of_response(text))])


def slots(events: DataFrame, data: str = "data", key: str = "row_id") -> DataFrame:
    """Texts of events by channel, in order: ord, channel, text, escape, snapshot (whole tool arguments) and ends (the channel is over)."""

    def make(text: str):
        found = frames.loads(text)
        over = frames.ends(found)
        if isinstance(found, dict):
            frames.merge_tool_calls(found)
        both = [(s, False) for s in frames.text_slots(found)] + [(s, True) for s in frames.snapshot_slots(found)]
        for i, (s, whole) in enumerate(both):
            yield i, s.channel, s.text, s.escape, whole, over is None or any(s.channel.startswith(p) for p in over)

    return _each(events, data, key, "ord long, channel string, text string, escape boolean, snapshot boolean, ends boolean", make)


def channel_texts(found: DataFrame, *others: Column) -> DataFrame:
    """sid, channel and the joined text of all fragments (sid, seq, ord, channel, text) in arrival order, and what ``others`` make of them in the same pass."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "ord", "text")))
    return found.groupBy("sid", "channel").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"), *others)


def taken_out(bodies: DataFrame, body: str = "body", key: str = "row_id") -> DataFrame:
    """token and content of each embedded file of each body, and the body without them, repeated for each."""

    def make(text: str):
        out, found, _ = blobs.taken_out(text)
        for token, value in found:
            yield out, token, value

    return _each(bodies, body, key, "slim string, token string, content string", make)
