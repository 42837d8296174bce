"""Functions that built-in ones can't express, as Arrow UDFs: one call for a batch of values."""

from __future__ import annotations

import gzip
import json
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_spans import valid


def has_duplicate_keys(text: str) -> bool | None:
    """Whether a JSON text repeats a key in some object; None if it is no JSON."""
    found = False

    def pairs(items):
        nonlocal found
        found |= len({k for k, _ in items}) < len(items)
        return None

    try:
        json.loads(text, object_pairs_hook=pairs)
    except (ValueError, RecursionError):
        return None
    return found


@F.pandas_udf(T.BooleanType())
def json_valid(texts: pd.Series) -> pd.Series:
    """Whether the whole text is one JSON value; the built-in parser stops at its end and refuses repeated keys."""
    return texts.map(valid)


@F.pandas_udf(T.BooleanType())
def duplicate_keys(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else has_duplicate_keys(t))


def decompressed(body: bytes, encoding: str, cap: int) -> bytes | None:
    """Body of at most ``cap`` bytes; None if it is longer, broken, or of an encoding that is not at hand here."""
    name = (encoding or "").strip().lower()
    try:
        if name in ("", "identity"):
            out = body
        elif name in ("gzip", "x-gzip"):
            out, rest = b"", body
            while rest:  # several members
                d = zlib.decompressobj(16 + zlib.MAX_WBITS)
                out += d.decompress(rest, max(1, cap + 1 - len(out)))
                if len(out) > cap or not d.eof:
                    return None
                rest = d.unused_data
        elif name == "deflate":
            try:
                d = zlib.decompressobj()
                out = d.decompress(body, cap + 1)
            except zlib.error:
                d = zlib.decompressobj(-zlib.MAX_WBITS)
                out = d.decompress(body, cap + 1)
        elif name == "zstd":
            import zstandard

            out = zstandard.ZstdDecompressor().decompress(body, max_output_size=cap + 1)
        else:
            return None
    except Exception:
        return None
    return out if len(out) <= cap else None


def decompress(body, encoding, cap: int = 128 << 20):
    @F.pandas_udf(T.BinaryType())
    def run(b: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decompressed(bytes(x), y, cap) for x, y in zip(b, e)], dtype=object)

    return run(body, encoding)


def compress(data: bytes, encoding: str) -> bytes:
    return gzip.compress(data) if encoding in ("gzip", "x-gzip") else zlib.compress(data) if encoding == "deflate" else data


@F.pandas_udf(T.BinaryType())
def compress_column(body: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else compress(bytes(b), (e or "").strip().lower()) for b, e in zip(body, encoding)], dtype=object)
