"""Chunked bodies as tables: each chunk's text, decoded in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.decoding import CAP, Decoder
from .ordered import carried

OUT = "sid string, seq long, text string, status string"


def decoded_chunks(chunks: DataFrame, cap: int = CAP) -> DataFrame:
    """``chunks`` (sid, seq, encoding, chunk: binary) decoded in the order of seq: the text that each adds, and the body's status up to there.

    A body may be cut anywhere, within a compressed block or a character; its texts join to the decoded whole. What comes
    at the end has the next number, with the last word on the status: ok, too_long (stopped at ``cap`` bytes as they came
    out), broken or unknown (see ``functions.decoding.Decoder``). A null chunk adds nothing. Memory is a decoder's window.
    """
    return carried(chunks.select("sid", "seq", "encoding", "chunk"), lambda: _walk(cap), OUT)


def _walk(cap: int) -> Callable:
    decoder: Decoder | None = None
    sid, last = "", -1

    def one(r) -> list[tuple]:
        nonlocal decoder, sid, last
        if r is None:
            text = decoder.finish() if decoder else ""
            return [(sid, last + 1, text, decoder.status if decoder else "ok")]
        decoder = decoder or Decoder(r.encoding, cap)
        sid, last = r.sid, r.seq
        return [(r.sid, r.seq, decoder.push(bytes(r.chunk or b"")), decoder.status)]

    return one
