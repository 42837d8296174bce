"""Document fingerprints by winnowing: DataFrame functions only.

A text is a sequence of units: runs of letters, runs of digits, single letters of scripts that are written without
spaces, and every other visible character. Every ``K`` consecutive units have a rolling hash, the value of a
polynomial in their hashes modulo a prime; the values of K units come from those of half as many, by shifted sums,
so no gram is hashed anew. Of every ``W`` consecutive hashes the least is chosen, the rightmost of equals, with its
position. Two texts that share K + W - 1 = 7 units in a row therefore share a chosen hash, and its positions tell
where. The fingerprint is the chosen hashes with their positions, in order.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, splitters

K, W = 4, 4
#: Modulus and base of the rolling hash.
_PRIME, _BASE = (1 << 31) - 1, 1_000_003
#: A chosen hash and its position in one long: 31 bits of hash, then 31 bits that fall with the position.
_SPAN = 1 << 31
#: One unit of a text.
UNIT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]+|\p{N}+|[^\x20\x09-\x0D]"


def _combined(g: Column, span: int) -> Column:
    """Hashes of 2 * ``span`` units from those of ``span``: h[i] * base^span + h[i + span], as long as both are there."""
    power = pow(_BASE, span, _PRIME)
    later = F.slice(g, span + 1, F.greatest(F.size(g) - span, F.lit(0)))
    both = F.zip_with(g, later, lambda a, b: (a * F.lit(power) + b) % F.lit(_PRIME))
    return F.when(F.size(g) > span, F.slice(both, 1, F.size(g) - span)).otherwise(g)


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``, the chosen (hash, position) longs of the text in order; empty for no units.

    Texts of fewer than K units have the grams of the longest half of K that they hold; of fewer than W grams, one window.
    """
    v, g = (next(n for i in count() if (n := f"{x}{i}") not in docs.columns) for x in ("grams", "hashes"))
    units = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0))
    df = docs.withColumn(g, F.transform(units, lambda u: F.pmod(F.xxhash64(u), F.lit(_PRIME))))
    span = 1
    while span < K:
        df = df.withColumn(v, _combined(F.col(g), span)).drop(g).withColumnRenamed(v, g)
        span *= 2
    df = df.withColumn(v, F.transform(g, lambda h, i: h * F.lit(_SPAN) + (F.lit(_SPAN - 1) - i))).drop(g).withColumnRenamed(v, g)
    span = 1
    while span < W:
        later = F.slice(g, span + 1, F.greatest(F.size(g) - span, F.lit(0)))
        df = df.withColumn(v, F.zip_with(g, later, lambda a, b: F.least(a, b))).drop(g).withColumnRenamed(v, g)  # past the end: shorter windows
        span *= 2
    windows = F.slice(g, 1, F.greatest(F.size(g) - W + 1, F.lit(1)))
    return df.withColumn(out, F.array_distinct(windows)).drop(g)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 31)))


def as_text(fingerprint: Column) -> Column:
    """``hash:position`` of each choice, hash in hexadecimal, position the first unit of the gram."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat_ws(":", F.lower(F.hex(F.shiftright(v, 31))), (F.lit(_SPAN - 1) - v.bitwiseAND(F.lit(_SPAN - 1))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two fingerprints' sets of hashes: common by all; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def with_next(docs: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """``docs`` (doc_id long, text, ``columns``) with next_<column> of each: that of the next document by descending doc_id.

    After the last comes the first. Rows of equal doc_id follow each other by a hash of their text; rows without
    doc_id come last. Documents are dealt once, into ranges of doc_id with near equal bytes; the first
    of each range is also sent to the range before it, so no task holds more than its range.
    """
    spark = docs.sparkSession
    docs, named = scratch.apart(docs, "doc_id", "text", *columns)
    rows = docs.withColumn("k1", F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1))).withColumn("k2", F.xxhash64("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    keys = scratch.table(rows.select("k1", "k2", size.alias("size")), "order-keys")
    parts = parts or scratch.parts_for(spark, 2 * (keys.agg(F.sum("size")).first()[0] or 0))
    cut = splitters.find(keys, parts, 0.05)
    firsts = cut.part(keys, "k1", "k2", "_part").groupBy("_part").agg(F.min(F.struct("k1", "k2")).alias("_first"))
    heads = sorted((r["_part"], r["_first"]["k1"], r["_first"]["k2"]) for r in firsts.collect())  # one row a range
    table = spark.createDataFrame([(p, k1, k2, heads[i - 1][0]) for i, (p, k1, k2) in enumerate(heads)], "_part int, _k1 long, _k2 long, _to int")
    is_first = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("shadow"))
    shadow = F.when(is_first, F.struct(F.col("_to").alias("part"), F.lit(1).alias("shadow")))
    spread = cut.part(rows, "k1", "k2", "_part").join(F.broadcast(table), "_part").withColumn("_copy", F.explode(F.array_compact(F.array(own, shadow))))
    spread = spread.withColumn("_range", F.col("_copy.part")).withColumn("_shadow", F.col("_copy.shadow"))
    order = Window.partitionBy("_range").orderBy("_shadow", "k1", "k2")
    following = spread.repartition(parts, "_range").select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return named(following.where("_shadow = 0").select(*docs.columns, *[f"next_{c}" for c in columns]))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third (rounded down) of code points replaced by as many first ones of ``following``."""
    n = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(following, F.lit(1), n))
