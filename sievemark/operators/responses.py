"""Whole responses: bodies of any framing restored in batch, and their texts by channel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames, json_spans
from ..functions import masking as M
from ..functions import texts as T
from ..streaming.restore import Session
from . import masking
from .tables import sliced

# Fixed value: most bytes of a response's text that are kept for findings.
KEPT_BYTES = 256 << 10


def sniffed(body: str) -> str | None:
    """Framing of a body that isn't what it was declared: sse if a line is data, ndjson if the first two lines are JSON."""
    lines = [x.strip() for x in body.replace("\r\n", "\n").split("\n") if x.strip()]
    if any(x.startswith("data:") for x in lines):
        return "sse"
    return "ndjson" if len(lines) > 1 and all(json_spans.valid(x) for x in lines[:2]) else None


def restored(body: str, known: dict, here: bool = True, content_type: str | None = None) -> M.Restored:
    """One whole body with its placeholders put back, by its content type; what isn't of that type goes by its own look.

    Texts that a stream cuts over its events are restored together: what is held at an event's end goes on with the
    next event of its channel, and comes before the event that ends the channel, or at the end of the body.
    """
    kind = (content_type or "").lower()
    if not here:
        return M.restored(body, known, False, False)
    streamed = "ndjson" if any(x in kind for x in ("ndjson", "jsonl", "x-json-stream")) else "sse" if "event-stream" in kind else None
    if streamed is None:
        json = "json" in kind
        if not json and not (kind.startswith("text/") or "xml" in kind or not kind.strip()):
            return M.Restored(body)
        if json_spans.valid(body):
            return json_spans.restored(body, known)
        streamed = sniffed(body) if json else None
        if streamed is None:
            return M.restored(body, known)
    session = Session()
    text = session.push(body.encode(), streamed, known, True)
    return M.Restored(text, *session.counts, session.samples)


def restore_bodies(bodies: DataFrame, mapping: DataFrame, own_hits: bool = False) -> DataFrame:
    """Response ``bodies`` (row_id, content_type, text, ...) restored whole; columns as of ``masking.restore``.

    JSON, server-sent events and lines of JSON of all four protocols; a broken body goes by its own look, so that no placeholder
    gets out for a wrong content type. Content that is no text stays as it is. The mapping is broadcast up to a bound; beyond
    it a pass of its own tells the suffixes that each body asks for, however its events cut them, and these are joined, or, with
    ``own_hits`` (see ``masking.restore``), only those that the texts held before. Equal to ``streaming.restore.restore_frames`` over any cut of the body.
    """
    return masking.restore(bodies, mapping, each=restored, beside="content_type", own_hits=own_hits)


CHANNELS = "row_id string, channel string, seq long, ord long, text string, snapshot boolean"


def slots(bodies: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """Texts of the events of whole ``bodies`` (row_id, content_type, text): channel, seq of the event, ord in it, text, and whether it repeats whole arguments; columns ``beside`` are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            at, out = [], []
            for n, (key, kind, body) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                for seq, data in enumerate(frames.events_of(body or "", kind or "")):
                    frames.merge_tool_calls(data)
                    both = [(s, False) for s in frames.text_slots(data)] + [(s, True) for s in frames.snapshot_slots(data)]
                    out += [(key, s.channel, seq, i, s.text, whole) for i, (s, whole) in enumerate(both)]
                    at += [n] * len(both)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = zip(*out) if out else [[]] * 6
            carried = [batch.column(3 + k).take(pa.array(at, pa.int64())) for k in range(len(beside))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), *carried], [*(c.split()[0] for c in CHANNELS.split(", ")), *beside])

    schema = ", ".join([CHANNELS, *(f"`{c}` {bodies.schema[c].dataType.simpleString()}" for c in beside)])
    return bodies.select(F.col("row_id").cast("string"), "content_type", "text", *beside).mapInArrow(run, schema)


def kept_texts(fragments: DataFrame, by: tuple[str, ...] = ("sid",), order: tuple[str, ...] = ("seq", "ord"), most: int = KEPT_BYTES) -> DataFrame:
    """The first ``most`` bytes of each group's fragments (text and the columns ``by`` and ``order``), joined in order; cut at a character.

    Fragments beyond the bound are dropped as rows, by the running size of those before them, so only what is kept is ever
    gathered: at most ``most`` bytes and one fragment for a group of any length. A group without any text has an empty one.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    running = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(size).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = fragments.select(*by, *order, "text", before.alias("_before"), F.row_number().over(running).alias("_n"))
    near = near.where((F.col("_before") < most) & (size > 0) | (F.col("_n") == 1))
    listed = F.array_sort(F.collect_list(F.struct("_n", F.coalesce("text", F.lit("")).alias("text"))))
    joined = near.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text"))
    return joined.withColumn("text", T.truncated(F.col("text"), most))
