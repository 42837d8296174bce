"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, from the vocabulary file alone
(``bpe.whole_tokens``). A text is cut where a single space stands between two other characters; no
pre-token crosses such a place. Each cut's pre-tokens count one when they are proven strings; only the
rest are merged. Cuts repeat, so their counts are kept in a bounded cache per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe

#: Pre-tokens of byte-level vocabularies, for text of ASCII and Latin-1 characters only.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_SIMPLE = re.compile("[\n -~\xa1-\xff]*")
_ODD_SPACE = re.compile(r"  | \n|\n |[^\S \n]|^ | \Z")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Counter:
    """Counts tokens of whole texts as the library does for the same file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.unproven = bpe.whole_tokens(path)
        self.merge = bpe.merger(path)
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = bpe.Memo(lambda cut: self.cut(" " + cut))
        self.__call__(" ")

    def cut(self, text: str) -> int:
        """Tokens of a stretch that starts and ends where no pre-token crosses."""
        if _SIMPLE.fullmatch(text) is None or any(s in text for s in self.specials):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        n = 0
        for piece in PRETOKEN.findall(text):
            piece = piece.encode()
            n += 1 if piece in self.whole else len(self.merge(piece))
        return n

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        cuts = text.split(" ") if _ODD_SPACE.search(text) is None else _LONE_SPACE.split(text)
        return self.cut(cuts[0]) + sum(map(self.memo.__getitem__, cuts[1:]))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a column of the token count of each whole text (0 for null or empty texts).

    ``vocabulary`` is the path of a byte-level tokenizer file on every machine. Rows, their order of columns
    and repeated rows are kept; an existing column named ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    rest = docs.select(*kept)
    schema = rest.withColumn(out, rest[text].isNotNull().cast("long")).schema
    at = kept.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            counts = [tokens(x) if x else 0 for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*kept, out])

    return rest.mapInArrow(count, schema)
