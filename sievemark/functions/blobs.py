"""Embedded files in texts: what they look like, and taking them out of JSON bodies and putting them back."""

from __future__ import annotations

import hashlib
import re

# Shapes of embedded files.
MIN_BASE64 = 8192
#: No shorter body holds an embedded file.
LEAST = len('"data:;base64,"')
_URI = re.compile(r"data:[^\0]{0,1011}?;base64,", re.I)
_PAYLOAD = re.compile(r"[A-Za-z0-9+/=_\s-]+", re.A)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"([ \t\r\n]*:)?', re.S)


def kind(value: str, least: int = MIN_BASE64) -> str | None:
    """data_uri, base64 (``least`` bytes or more, three classes of characters with a symbol among them, not hexadecimal) or None."""
    if "\\" in value or not value:
        return None
    if (m := _URI.match(value)) and m.end() <= 1024 and _PAYLOAD.fullmatch(value, m.end()):
        return "data_uri"
    if len(value) < least or not _BASE64.fullmatch(value) or re.fullmatch("[0-9a-fA-F]+", value):
        return None
    symbol = re.search("[+/=_-]", value)
    return "base64" if symbol and 1 + sum(bool(re.search(c, value)) for c in ("[A-Z]", "[a-z]", "[0-9]")) >= 3 else None


def taken_out(body: str) -> tuple[str, list[tuple[str, str]], int]:
    """The body with a token of equal width for each embedded file in a value, the tokens with what they stand for, and its bytes."""
    nonce = hashlib.sha256(body.encode()).hexdigest()[:12]
    found: list[tuple[str, str]] = []

    def swap(m: re.Match) -> str:
        if m[2] or not kind(m[1]):
            return m[0]
        found.append((f"kmb-{nonce}-{len(found):06}", m[1]))
        return f'"{found[-1][0]}"'

    out = _LITERAL.sub(swap, body)
    return out, found, sum(len(v.encode()) for _, v in found)


def put_back(body: str, found: list[tuple[str, str]]) -> str | None:
    """The body with its embedded files again; None if a token is gone."""
    if not found:
        return body
    by, seen = dict(found), set()

    def back(m: re.Match) -> str:
        seen.add(m[0])
        return by.get(m[0], m[0])

    out = re.sub("kmb-[0-9a-f]{12}-[0-9]{6}", back, body)
    return out if set(by) <= seen else None
