"""Line deduplication over levelled sorted runs of line hashes.

A run holds, for each line key, the number of documents and the largest doc_id that hold it, sorted by key.
Batches of documents add runs at level 0; as soon as a level has ``fanout`` runs they are merged into one run
of the next level, so each key is rewritten once a level. Runs of different documents merge by sum and
maximum. Each batch's lines meet the runs of the batches before it in a sort-merge join that tells the lines seen
before from new ones, and then add their own run. ``dedup`` takes batches by falling doc_id, so a line that is new is
that of the largest doc_id. All steps are DataFrame operations.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: The six ASCII white-space characters.
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key has at least ``min_chars`` code points: doc_id, _text, _pos, k1, k2.

    _text is a hash of the document's text and, with doc_id, tells its row; (k1, k2) are 96 bits of the key.
    """
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("_text"), F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line")
    )
    lines = lines.where(F.length("_line") >= min_chars).withColumn("_line", line_key(F.col("_line")))
    return lines.where(F.length("_line") >= min_chars).select("doc_id", "_text", "_pos", F.xxhash64("_line").alias("k1"), F.hash("_line").alias("k2"))


class LineRuns:
    """Levelled sorted runs of line keys, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, lines: DataFrame) -> None:
        """Add a batch of keyed lines as a run. No document may be in two batches."""
        self._put(self._run(lines), 0)

    def _run(self, lines: DataFrame, level: int = 0) -> DataFrame:
        once = lines.select("k1", "k2", "doc_id").distinct()
        run = once.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        return scratch.table(run.sortWithinPartitions("k1", "k2"), f"line-run-{level}")

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._put(scratch.table(self._merge(merged).sortWithinPartitions("k1", "k2"), f"line-run-{level + 1}"), level + 1)
            for r in merged:
                scratch.drop(r)

    def meet(self, lines: DataFrame, keeper: str) -> DataFrame:
        """Those of a batch's lines that the runs hold or that stand in the batch's ``keeper`` (first or last) document too.

        The others are new and stay. The batch is then a run itself.
        """
        own, state = self._run(lines), self.state()
        joined = lines.join(own.select("k1", "k2", F.col(keeper).alias("_keeper")), ["k1", "k2"])
        again = F.col("doc_id") != F.col("_keeper")
        if state is not None:
            state = scratch.table(state, "line-state") if len(self.levels) > 1 or len(self.levels[0]) > 1 else state  # merged runs: both sides plain shuffles
            joined = joined.join(state.select("k1", "k2", F.lit(True).alias("_held")), ["k1", "k2"], "left")
            again = again | F.col("_held").isNotNull()
        seen = scratch.table(joined.where(again).select(*lines.columns), "line-seen")
        self._put(own, 0)
        return seen

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for r in runs[1:]:
            union = union.unionByName(r)
        return union.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first"), F.max("last").alias("last"))

    def state(self) -> DataFrame | None:
        """All keys with their number of documents and largest doc_id; None before the first batch."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        return runs[0] if len(runs) == 1 else self._merge(runs)

    def ingest(self, docs: DataFrame, min_chars: int = 20) -> DataFrame:
        """For arriving batches: ``docs`` without lines that earlier batches or smaller doc_ids of this one hold.

        The batch's lines are merge-joined with the runs, then added to them.
        """
        lines = scratch.table(keyed_lines(docs, min_chars), "line-batch")
        return without_lines(docs, self.meet(lines, "first").select("doc_id", "_text", "_pos"))


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with text less the lines in ``dropped`` (doc_id, _text, _pos), n_lines before and n_dropped.

    Documents that lose nothing keep their text as it is, null included. Kept lines are the stretches between
    dropped positions, so the work is in proportion to a document's lines.
    """
    docs, named = scratch.apart(docs, "doc_id", "text", without=("n_lines", "n_dropped"))
    kept = docs.columns
    gone = dropped.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    rows = docs.select(*kept, F.xxhash64("text").alias("_text")).join(gone, ["doc_id", "_text"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    m = F.size("_gone")
    ends = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size("_lines")))
    stretches = F.transform(F.sequence(F.lit(1), m + 1), lambda j: F.slice("_lines", F.element_at("_ends", j) + 2, F.element_at("_ends", j + 1) - F.element_at("_ends", j) - 1))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return named(
        rows.withColumn("_lines", lines).withColumn("_ends", ends).select(
            *[text.alias("text") if c == "text" else F.col(c) for c in kept],
            F.size("_lines").cast("long").alias("n_lines"),
            F.when(F.col("_gone").isNull(), 0).otherwise(m).cast("long").alias("n_dropped"),
        )
    )


def dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 4) -> DataFrame:
    """``docs`` less every line whose key at least ``min_docs`` documents hold, but for the largest doc_id's.

    Adds n_lines (before dropping; a null or empty text is one empty line) and n_dropped; columns of these names are
    replaced, others carried. Keys shorter than ``min_chars`` code points never drop. Rows with equal doc_id are
    one document to the count; rows without doc_id count for nothing and stay as they are. A document
    left without lines has an empty text.
    """
    lines = scratch.table(keyed_lines(docs, min_chars), "lines")
    runs = LineRuns(docs.sparkSession, fanout)
    seen = None
    for own in _falling(lines, batches):
        again = runs.meet(own, "last")
        seen = again if seen is None else seen.unionByName(again)
    common = scratch.table(runs.state().where(F.col("n_docs") >= min_docs).select("k1", "k2"), "line-common")
    return without_lines(docs, seen.join(common, ["k1", "k2"], "left_semi").select("doc_id", "_text", "_pos"))


def _falling(lines: DataFrame, batches: int) -> list[DataFrame]:
    """``lines`` in batches of near equal numbers, those of larger doc_ids first; ids that are no numbers are one batch."""
    if batches < 2 or not isinstance(lines.schema["doc_id"].dataType, T.IntegralType):
        return [lines]
    found = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    out, above = [], F.lit(True)
    for cut in sorted(set(found), reverse=True):
        out.append(lines.where(above & (F.col("doc_id") > cut)))
        above = F.col("doc_id") <= cut
    return [*out, lines.where(above)]
