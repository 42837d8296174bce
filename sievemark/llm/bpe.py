"""Byte-pair encoding of single pieces, from the vocabulary files of public tokenizers.

Rank-order merging of adjacent symbols whose concatenation is a vocabulary string gives the same result
as merging the listed pairs, provided that every vocabulary string, encoded alone, ends as that one token:
inside a stretch that no merge has crossed, the merges are those of the stretch encoded alone. ``whole_tokens``
checks this for every string of a vocabulary; strings that fail it are unreachable and left out of the ranks.
"""

from __future__ import annotations

import json
from functools import lru_cache

import tiktoken

#: Byte that no UTF-8 text holds; it stands for the end-of-word mark.
END = b"\xff"


def byte_alphabet() -> dict[str, int]:
    """Printable character of each byte in byte-level vocabularies, by the public rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_pairs(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The listed-pair merge loop: lowest rank first, leftmost first. Only for proofs, not for corpora."""
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> tuple[dict[bytes, int], int]:
    """Vocabulary strings that encode alone as one token, as bytes with their ids, and how many fail.

    Word-end vocabularies mark a final symbol by ``</w>``; it becomes the byte END.
    """
    model = json.load(open(path, encoding="utf-8"))["model"]
    suffix = model.get("end_of_word_suffix") or ""
    alphabet = byte_alphabet()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {p: i for i, p in enumerate(pairs)}
    proven, failed = {}, 0
    for token, i in model["vocab"].items():
        ended = bool(suffix) and token.endswith(suffix)
        body = token[: len(token) - len(suffix)] if ended else token
        if not body or any(c not in alphabet for c in body):
            continue
        symbols = list(body)
        if ended:
            symbols[-1] += suffix
        if merge_pairs(symbols, ranks) == [token]:
            proven[bytes(alphabet[c] for c in body) + (END if ended else b"")] = i
        else:
            failed += 1
    return proven, failed


@lru_cache(maxsize=4)
def merger(path: str):
    """Function from the bytes of one piece (ended by END in word-end vocabularies) to its ids.

    In a word-end vocabulary the mark joins the last byte before any other merge, since those strings have
    the lowest ids after single bytes.
    """
    proven, _ = whole_tokens(path)
    ranks = dict(proven)
    free = max(ranks.values()) + 1
    for b in range(256):
        if bytes([b]) not in ranks:
            ranks[bytes([b])] = free
            free += 1
    core = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return core._core_bpe.encode_single_piece


class Memo(dict):
    """Two-generation cache of a function, so that memory stays bounded and frequent keys stay."""

    def __init__(self, function, limit: int = 250_000):
        super().__init__()
        self.function, self.limit, self.old = function, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
