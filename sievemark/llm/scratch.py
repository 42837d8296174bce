"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Writing a table cuts the lineage: a lost executor costs the tasks it ran, not what came before.
Only where that setting is absent and all of Spark runs in this process (tests, a laptop) is a folder of our own made
and deleted at exit; on a cluster without it there is no shared folder, and an error says so.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of this application."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="sievemark-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        named = f"file://{_own[app]}"
    return f"{named.rstrip('/')}/sievemark-{app}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def union(spark: SparkSession, frames: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """One table of all ``frames``, each written on its own before the next is made."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([], schema).write.parquet(f"{path}/pass=0")
    for k, df in enumerate(frames, 1):
        df.write.option("compression", "zstd").parquet(f"{path}/pass={k}")
    return spark.read.schema(schema).parquet(f"{path}/pass=*")


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`table`, once nothing reads it any more."""
    jvm: Any = df.sparkSession.sparkContext._jvm
    home = folder(df.sparkSession)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sievemark-" in path and home.split("://")[-1] in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over. Spark deletes them when the driver's collector finds their plans unused, which without a call may be half an hour later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def apart(df: DataFrame, *own: str, without: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with plain names (c0, c1, ...) for all columns but ``own``, so that none can meet an operator's working names, and what gives them back.

    Columns in ``without`` are left out. The names are given back in their order, before the columns that came since.
    """
    kept = [c for c in df.columns if c not in without]
    plain = {c: c if c in own else f"c{i}" for i, c in enumerate(kept)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(plain[c]).alias(c) for c in kept], *[c for c in out.columns if c not in set(plain.values())])

    return df.select(*[F.col(f"`{c}`").alias(plain[c]) for c in kept]), back


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a part that one task sorts, and the most parts that are made for that reason.
PART_BYTES, MOST_PARTS = 64 << 20, 4096


def parts_for(spark: SparkSession, n_bytes: int) -> int:
    """Number of parts for ``n_bytes`` to be sorted in: they grow in number before they grow in size."""
    return max(shuffle_partitions(spark), min(MOST_PARTS, -(-n_bytes // PART_BYTES)))


#: Most ids of a broadcast set: a few tens of MB as a hashed relation.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` whose doc_id is (``left_semi``) or is not (``left_anti``) in the written table ``ids`` (doc_id).

    The ids are counted first: up to BROADCAST_IDS of them are broadcast, more are joined by a shuffle.
    """
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, rows["doc_id"].eqNullSafe(ids["doc_id"]), how)
