"""How long values keep their tokens: each use extends a mapping's time to live; logs warm a new one up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masking import PLACEHOLDER

# Seconds that a mapping lives after its last use, and mappings that a session starts with.
TTL_S, WARM = 86_400, 10_000


def lifetimes(uses: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Lifetimes of each (label, value) of ``uses`` (label, value, token, ts): born, touched (its last use) and uses.

    A use within ``ttl_s`` seconds of the one before, the end included, goes on with the lifetime; a later one begins another.
    Uses are first summed by spans of ``ttl_s``, within which none can break, so a value with a large share of all uses
    is a few rows when values are brought together. Uses without a time or a value don't count.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = uses.where("ts IS NOT NULL AND value IS NOT NULL").select("label", "value", "token", micros.alias("at"))
    span = F.floor(F.col("at") / F.lit(ttl_s * 1_000_000)).cast("long")
    spans = whole.groupBy("label", "value", span.alias("span")).agg(F.min("at").alias("born"), F.max("at").alias("touched"), F.count(F.lit(1)).alias("uses"), F.max_by("token", "at").alias("token"))
    order = Window.partitionBy("label", "value").orderBy("span")
    new = F.coalesce((F.col("born") - F.lag("touched").over(order) > ttl_s * 1_000_000), F.lit(True)).cast("int")
    told = spans.withColumn("new", new).withColumn("life", F.sum("new").over(order))
    lives = told.groupBy("label", "value", "life").agg(F.min("born").alias("born"), F.max("touched").alias("touched"), F.sum("uses").alias("uses"), F.max_by("token", "span").alias("token"))
    moment = lambda c: F.timestamp_micros(c).alias(c)
    return lives.select("label", "value", "token", moment("born"), moment("touched"), "uses")


def live_at(uses: DataFrame, clock: Column, ttl_s: int = TTL_S) -> DataFrame:
    """Mappings that live at ``clock``: the last lifetime of each value, by the uses up to then, if it hasn't ended. ``clock`` is a timestamp, a literal or a column of ``uses``."""
    last = lifetimes(uses.where(F.col("ts").cast("timestamp") <= clock), ttl_s)
    return last.where(F.unix_micros("touched") + ttl_s * 1_000_000 >= F.unix_micros(clock.cast("timestamp")))


def expired_stream(uses: DataFrame, ttl_s: int = TTL_S, late: str = "1 minute") -> DataFrame:
    """Lifetimes as they end, over a stream of ``uses``: rows come once the watermark has passed a value's last use by ``ttl_s`` seconds.

    State is one row for each living lifetime; a use within the time extends it, so a touched mapping outlives an untouched one.
    """
    gap = f"{ttl_s} seconds 1 microsecond"  # a session window's end is open; a use at the very end still counts
    timed = uses.where("ts IS NOT NULL AND value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    lives = timed.groupBy("label", "value", F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("touched"), F.count(F.lit(1)).alias("uses"), F.max_by("token", "ts").alias("token"))
    return lives.select("label", "value", "token", F.col("w.start").alias("born"), "touched", "uses")


def warm_start(log: DataFrame, most: int = WARM) -> DataFrame:
    """The mapping that a log (event_id, label, value, token) gives a new session: the ``most`` newest values, each with its newest token.

    Empty tokens and values, and values that are placeholders themselves, are left out. Columns label, value, token and
    rank (1: the newest). One row a value is brought together, then ``most`` rows.
    """
    fine = log.where((F.coalesce("token", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != "") & ~F.col("value").rlike(PLACEHOLDER))
    newest = fine.groupBy("value").agg(F.max_by(F.struct("label", "token"), F.struct("event_id", "token")).alias("n"), F.max("event_id").alias("event_id"))
    top = newest.orderBy(F.desc("event_id"), "value").limit(most)
    order = Window.orderBy(F.desc("event_id"), "value")  # over ``most`` rows
    return top.select("n.label", "value", "n.token", F.row_number().over(order).alias("rank"))
