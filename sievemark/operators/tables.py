"""Tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names for the whole cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Most rows of a table of short values that is broadcast.
BROADCAST_ROWS = 250_000
#: Bytes of texts that a task of Python works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Without one only a session within one process has a place of its own."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sievemark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def kept(rows: DataFrame) -> DataFrame:
    """``rows``, computed once and written."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with texts, computed once and written as Parquet, so that further reads take only the columns they want."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over as many partitions as shuffles have: small rows whose work is large would else be put together into few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions") or 1), spark.sparkContext.defaultParallelism), *keys)


def sliced(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in order, in slices of at most ``most`` bytes of text in ``column``: what a worker holds doesn't grow with the batch."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows or not batch.num_rows:
            yield batch.slice(start)
