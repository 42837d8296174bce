"""Bodies that arrive in chunks, decoded as they come: compression and UTF-8 carried from chunk to chunk, up to a cap."""

from __future__ import annotations

import codecs
import zlib

# Fixed value: most bytes of a decoded body.
CAP = 128 << 20
#: Bytes that a step of decompression may give at a time.
STEP = 1 << 16


class Decoder:
    """One body. ``push`` gives the text of one more chunk, ``finish`` the rest; ``status`` tells how it stands.

    ok; too_long: more than ``cap`` bytes came out, found while they come, and nothing goes out from then on; broken: the
    bytes are no such encoding, or end early; unknown: an encoding that can't be decoded here, passed on as nothing. gzip may have
    several members; deflate may come with or without its zlib header. Bytes that are no UTF-8 become replacement characters.
    """

    def __init__(self, encoding: str | None, cap: int = CAP):
        self.encoding = (encoding or "").strip().lower() or "identity"
        self.cap, self.size, self.status = cap, 0, "ok"
        self.text = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = b""
        self.inner = None
        self.begun = False
        if self.encoding in ("gzip", "x-gzip"):
            self.inner = zlib.decompressobj(16 + zlib.MAX_WBITS)
        elif self.encoding == "zstd":
            import zstandard

            self.inner = zstandard.ZstdDecompressor().decompressobj()
        elif self.encoding not in ("identity", "deflate"):
            self.status = "unknown"

    def push(self, chunk: bytes) -> str:
        if self.status != "ok" or not chunk:
            return ""
        out = []
        try:
            for data in self._decoded(chunk):
                self.size += len(data)
                if self.size > self.cap:
                    self.status = "too_long"
                    return ""
                out.append(self.text.decode(data))
        except Exception:
            self.status = "broken"
            return ""
        return "".join(out)

    def _decoded(self, chunk: bytes):
        if self.encoding == "identity":
            yield chunk
        elif self.encoding == "zstd":
            self.begun = True
            for at in range(0, len(chunk), 256):  # a block gives 128 KiB at most, so pieces stay small
                yield self.inner.decompress(chunk[at : at + 256])
        else:
            yield from self._inflated(chunk)

    def _inflated(self, chunk: bytes):
        if self.encoding == "deflate" and self.inner is None:
            self.first += chunk
            if len(self.first) < 2:
                return
            chunk, self.first = self.first, b""
            headed = chunk[0] & 15 == 8 and (chunk[0] << 8 | chunk[1]) % 31 == 0
            self.inner = zlib.decompressobj(zlib.MAX_WBITS if headed else -zlib.MAX_WBITS)
        self.begun = True
        while chunk:
            if self.inner.eof:
                if self.encoding == "deflate":
                    return  # what follows the end of the stream is no part of it
                self.inner = zlib.decompressobj(16 + zlib.MAX_WBITS)
            while True:
                data = self.inner.decompress(chunk, STEP)
                chunk = self.inner.unconsumed_tail
                yield data
                if not chunk or self.inner.eof:
                    break
            chunk = self.inner.unused_data if self.inner.eof else b""

    def finish(self) -> str:
        if self.status != "ok":
            return ""
        early = bool(self.first) or (self.begun and self.encoding != "identity" and not self.inner.eof)
        if early:
            self.status = "broken"
            return ""
        return self.text.decode(b"", True)
