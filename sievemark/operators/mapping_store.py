"""The mapping table over time: words seeded into it, uses merged into it, and versions of it that a retry can't double."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import masking as M
from ..functions.texts import safe_label
from .masking import token
from .tables import kept

MAPPING = "value string, label string, token string, custom boolean, created timestamp, touched timestamp"


def suffix(token_: Column) -> Column:
    return F.substring(token_, -8, 6)


def seed_words(current: DataFrame, words: DataFrame, key: str, now: Column) -> DataFrame:
    """``current`` (columns of MAPPING) with the dictionary ``words`` (word, label) as its custom mappings.

    Custom mappings of words that are gone are dropped; a word whose label stands for the same in a placeholder keeps its
    token and takes the new label and time; one whose label changed, or that is new, gets a token of its own from the
    word and ``key``, with a suffix that no other mapping has (of words that want the same, the least has it, the others
    count on). Seeding twice gives the same as once, but for the time of the last use. Other mappings stay as they are. Of
    repeated words the least label counts; null and empty ones are none. All steps are joins by word or suffix.
    """
    found = current.where("NOT custom")
    active = words.where(F.coalesce("word", F.lit("")) != "").groupBy(F.col("word").alias("value")).agg(F.min(F.coalesce("label", F.lit(""))).alias("new_label"))
    old = current.where("custom").select("value", "token", "created", F.col("label").alias("old_label"))
    both = kept(active.join(old, "value", "left"))
    same = F.col("token").isNotNull() & (safe_label(F.col("old_label")) == safe_label(F.col("new_label")))
    stays = both.where(F.coalesce(same, F.lit(False))).select("value", F.col("new_label").alias("label"), "token", F.lit(True).alias("custom"), "created", now.cast("timestamp").alias("touched"))
    open_ = both.where(~F.coalesce(same, F.lit(False))).select("value", F.col("new_label").alias("label"), F.lit(0).alias("counter"))
    used = kept(found.select(suffix(F.col("token")).alias("suffix")).unionByName(stays.select(suffix(F.col("token")).alias("suffix"))).distinct())
    done: list[DataFrame] = []
    first = Window.partitionBy("suffix").orderBy("counter", "value")
    open_ = kept(open_)
    while not open_.isEmpty():
        asked = open_.withColumn("token", token(F.col("label"), F.col("value"), key, F.col("counter"))).withColumn("suffix", suffix(F.col("token")))
        told = kept(asked.withColumn("first", F.row_number().over(first) == 1).join(used.withColumn("taken", F.lit(True)), "suffix", "left"))
        wins = F.col("first") & F.col("taken").isNull()
        got = told.where(wins)
        done.append(got.select("value", "label", "token", F.lit(True).alias("custom"), now.cast("timestamp").alias("created"), now.cast("timestamp").alias("touched")))
        used = kept(used.unionByName(got.select("suffix")))
        open_ = kept(told.where(~wins).select("value", "label", (F.col("counter") + 1).alias("counter")))
    out = found.unionByName(stays)
    for part in done:
        out = out.unionByName(part)
    return out.select(*[c.split()[0] for c in MAPPING.split(", ")])


def upsert(current: DataFrame, uses: DataFrame) -> DataFrame:
    """``current`` with ``uses`` (value, label, token, custom, ts) merged in by token: created stays the first time, touched, value and label are those of the last.

    The merge takes least and greatest times only, so the order of merges, a merge of parts, and a part that is merged again
    all give the same; sums are partial before they are brought together. Rows without a token or a time don't count.
    """
    new = uses.where("token <> '' AND ts IS NOT NULL").select("value", "label", "token", "custom", F.col("ts").cast("timestamp").alias("created"), F.col("ts").cast("timestamp").alias("touched"))
    both = current.select(*new.columns).unionByName(new)
    last = F.max(F.struct("touched", "value", "label", "custom"))
    merged = both.groupBy("token").agg(last.alias("l"), F.min("created").alias("created"), F.max("touched").alias("touched"))
    return merged.select("l.value", "l.label", "token", "l.custom", "created", "touched")


class Versions:
    """A table in versions under a folder that all share: each commit is a whole new version, named by its number and its batch.

    A version counts once its folder has its final name, to which it is moved when it is all written; readers see the last
    one that counts, and keep seeing it while the next is made. A batch that was committed is never committed again, so a
    retry changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self) -> tuple[Any, Any]:
        jvm: Any = self.spark.sparkContext._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def list(self) -> list[tuple[int, str]]:
        """Number and batch of each version, in order."""
        path, fs = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted((int(m[1]), m[2]) for n in names if (m := re.fullmatch(r"v(\d{9})-([\w.-]+)", n)))

    def read(self, number: int | None = None) -> DataFrame:
        """The last version, or one by its number; an empty table before the first."""
        found = [v for v in self.list() if number is None or v[0] == number]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1][0]:09d}-{found[-1][1]}")

    def commit(self, batch: str, make) -> int:
        """``make`` is given the last version and gives the next; the number of the version that holds ``batch``."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named by letters, digits and ._-")
        done = self.list()
        if held := [n for n, b in done if b == batch]:
            return held[-1]
        number = done[-1][0] + 1 if done else 1
        path, fs = self._fs()
        draft = f"{self.path}/_draft-{batch}"
        make(self.read()).write.mode("overwrite").parquet(draft)
        if not fs.rename(path(draft), path(f"{self.path}/v{number:09d}-{batch}")):
            raise OSError(f"version {number} could not be put in place")
        return number

    def keep_last(self, n: int) -> None:
        """Delete all but the last ``n`` versions."""
        path, fs = self._fs()
        for number, batch in self.list()[: -n or None]:
            fs.delete(path(f"{self.path}/v{number:09d}-{batch}"), True)


def clear_all(tables: dict[str, Versions], batch: str, keep: tuple[str, ...] = ("daily_stats",)) -> None:
    """An empty version of each table but those in ``keep``: log, words and traces go, the day's counters stay. A retry changes nothing."""
    for name, table in tables.items():
        if name not in keep:
            table.commit(batch, lambda now: now.limit(0))


def lookup(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """``values`` (label, value, ...) with the token that each has in ``mapping``, dictionary words first; null where it has none. A value that is a placeholder itself is its own token."""
    best = mapping.groupBy("value").agg(F.max_by("token", F.struct("custom", "touched", "token")).alias("token"))
    got = values.join(best, "value", "left")
    return got.withColumn("token", F.when(F.col("value").rlike(rf"\A{M.PLACEHOLDER}\z"), F.col("value")).otherwise(F.col("token")))


def originals(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """``found`` (token, ...) with the value behind each token, null where there is none; a later use wins where two rows have a token."""
    best = mapping.groupBy("token").agg(F.max_by("value", F.struct("touched", "value")).alias("value"))
    return found.join(best, "token", "left")


# Fixed value: how deep placeholders within values are followed.
LEVELS = 5


def unwrapped(mapping: DataFrame, levels: int = LEVELS) -> DataFrame:
    """token and value of ``mapping`` with values that are placeholders themselves followed, up to ``levels`` times; a cycle ends there as well.

    Each level joins only the rows that are not through yet.
    """
    rows = mapping.select("token", "value")
    nested = F.col("value").rlike(rf"\A{M.PLACEHOLDER}\z")
    done, open_ = rows.where(~nested), kept(rows.where(nested))
    inner = kept(rows.select(F.col("token").alias("_token"), F.col("value").alias("_value")))
    for _ in range(levels):
        if open_.isEmpty():
            break
        step = kept(open_.join(inner, F.col("value") == F.col("_token"), "left").select("token", F.coalesce("_value", "value").alias("value"), F.col("_token").isNull().alias("ends")))
        done = done.unionByName(step.where(~nested | F.col("ends")).select("token", "value"))
        open_ = step.where(nested & ~F.col("ends")).select("token", "value")
    return done.unionByName(open_)


def by_suffix(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """``found`` (label, suffix, ...; of deformed placeholders) with the token meant: the only one that has the suffix, if its label is the same; null else."""
    only = mapping.groupBy(suffix(F.col("token")).alias("suffix")).agg(F.min("token").alias("token"), F.count_distinct("token").alias("n")).where("n = 1").drop("n")
    got = found.join(only, "suffix", "left")
    same = safe_label(F.col("label")) == F.regexp_extract("token", r"\A\{\{([A-Z0-9]+)_", 1)
    return got.withColumn("token", F.when(same, F.col("token")))
