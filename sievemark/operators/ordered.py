"""Rows of sessions in order, with a short carry from one row to the next."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import spread


def carried(rows: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``rows`` (sid, seq, ...) by sid and in order through what ``make`` gives for each session.

    That is called with each row of the session, and with None at its end, for a list of rows of ``schema``. Rows are sorted
    within partitions and pass one by one; no session is gathered, so a long one costs time in one task, but no memory.
    """
    kinds = to_arrow_schema(T._parse_datatype_string(schema))
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(kinds), kinds)], kinds.names)
        row = namedtuple("row", columns)
        sid, one = None, None
        for batch in batches:
            out: list[tuple] = []
            for r in map(row._make, zip(*(c.to_pylist() for c in batch.columns))):
                if one is None or r.sid != sid:
                    out += one(None) if one else []
                    sid, one = r.sid, make()
                out += one(r)
            yield made(out)
        if one:
            yield made(one(None))

    return spread(rows, "sid").sortWithinPartitions("sid", "seq").mapInArrow(run, schema)
