"""Dangerous commands in responses: where they are looked for, which rule hits first, what becomes of them, and their record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import texts as T
from . import bodies as B
from . import detect

Rules = list[tuple[str, str, str]]


def windows(text: Column) -> Column:
    """All of a text of up to 1 MiB, else 64 KiB at both ends: what a proxy has time for. Commands are looked for in whole texts."""
    return F.when(F.octet_length(text) <= P.SCAN_WHOLE, F.array(text)).otherwise(F.array(T.truncated(text, P.SCAN_EDGE), T.last_bytes(text, P.SCAN_EDGE)))


#: Words without which a built-in rule can't hit, in lower case; they are looked for first.
HINTS = {
    "builtin-rm-root": ("rm",), "builtin-rm-root-nopreserve": ("no-preserve-root",), "builtin-rm-home": ("rm",), "builtin-del-win": ("del", "erase", "remove-item"),
    "builtin-format": ("format", "mkfs"), "builtin-drop-db": ("drop", "truncate"), "builtin-dd": ("/dev/",), "builtin-forkbomb": (":()",),
}


def first_hit(text: Column, rules: Rules | None = None, allow: tuple[str, ...] = ()) -> Column:
    """id, label and snippet (120 characters) of the first rule that hits anywhere in the text, null if none does.

    Of a rule the first hit that no allowed pattern matches counts.
    """
    hits = []
    low = F.lower(text)
    for id_, label, pattern in P.COMMANDS if rules is None else rules:
        may = F.lit(id_ not in HINTS)
        for word in HINTS.get(id_, ()):
            may = may | F.contains(low, F.lit(word))
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.btrim(v, F.lit(" \t\n\r\x0b\x0c")))
        kept = F.filter(found, lambda v: (v != "") & ~F.coalesce(*[F.when(v.rlike(a), True) for a in allow], F.lit(False)))
        hits.append(F.when(may & (F.size(kept) > 0), F.struct(F.lit(id_).alias("id"), F.lit(label).alias("label"), F.substring(F.get(kept, F.lit(0)), 1, P.SNIPPET).alias("snippet"))))
    return F.coalesce(*hits)


def channel_kind(channel: Column) -> Column:
    """tool, text or reason; protocol ids and tool outputs are text."""
    low = F.lower(channel)
    both = F.array(low, F.replace(low, F.lit(".x"), F.lit(".")))
    holds = lambda marks: F.exists(both, lambda c: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(c, m)))
    meta = F.exists(both, lambda c: F.regexp_extract(c, r"([^.]*)\z", 1).isin(P.META_KEYS))
    slot = F.exists(both, lambda c: c.rlike(r"\.tool([0-9]|\z)"))
    return F.when(meta | holds(P.TOOL_OUTPUTS), "text").when(holds(P.REASON_MARKS), "reason").when(slot | holds(P.TOOL_MARKS), "tool").otherwise("text")


def rewritten(text: Column, rules: Rules | None = None, notice: str = P.NOTICE) -> Column:
    """``text`` with each command replaced by a fixed notice that does nothing."""
    for _, _, pattern in P.COMMANDS if rules is None else rules:
        text = F.regexp_replace(text, pattern, notice.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def judged(rows: DataFrame, mode: str = "observe", channels: tuple[str, ...] = ("tool",), rules: Rules | None = None, allow: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (sid, channel, text, ...) with kind, hit, blocked and the text that goes on.

    mode observe passes all on, rewrite puts a notice in the place of commands, block empties the text. Only kinds in ``channels``
    are judged. A null text has no hit.
    """
    kind = channel_kind(F.col("channel"))
    hit = F.when(kind.isin(*channels), first_hit(F.col("text"), rules, allow))
    seen = rows.withColumn("kind", kind).withColumn("hit", hit)
    out = {"observe": F.col("text"), "rewrite": F.when(F.col("hit").isNotNull(), rewritten(F.col("text"), rules)).otherwise(F.col("text")), "block": F.when(F.col("hit").isNotNull(), "").otherwise(F.col("text"))}[mode]
    return seen.withColumn("blocked", F.col("hit").isNotNull() & F.lit(mode != "observe")).withColumn("out", out)


def record(hits: DataFrame) -> DataFrame:
    """One row for each (sid, rule, kind, snippet) of judged rows (sid, ts, kind, hit, blocked): first time, and whether any was blocked. Credentials in snippets are redacted."""
    snippet = F.substring(detect.redact(F.col("hit.snippet")), 1, P.SNIPPET)
    flat = hits.where("hit IS NOT NULL").select("sid", "ts", F.concat_ws(" ", "hit.id", F.nullif(F.col("hit.label"), F.lit(""))).alias("rule"), "kind", snippet.alias("snippet"), "blocked")
    return flat.groupBy("sid", "rule", "kind", "snippet").agg(F.min("ts").alias("ts"), F.bool_or("blocked").alias("blocked"))


def hit_events(recorded: DataFrame) -> DataFrame:
    """A CMDHIT event for each row of ``record``: the rule as its reason, the snippet's first 200 bytes as its message."""
    return recorded.select("sid", F.lit("CMDHIT").alias("type"), F.col("rule").alias("reason"), "kind", F.lit(1).alias("count"), T.truncated(F.col("snippet"), 200).alias("message"), "blocked", "ts")


def request_snippets(requests: DataFrame, rules: Rules | None = None) -> DataFrame:
    """sid and snippet of every command that a request (sid, text) holds itself."""
    each = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for _, _, p in (P.COMMANDS if rules is None else rules)]
    cut = F.transform(F.concat(*each), lambda v: F.substring(F.btrim(v, F.lit(" \t\n\r\x0b\x0c")), 1, P.SNIPPET))
    return requests.where("text IS NOT NULL").select("sid", F.explode(F.array_distinct(cut)).alias("snippet")).where("snippet <> ''").distinct()


def without_echoes(hits: DataFrame, requests: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Judged rows whose snippet the session's own request (sid, text) doesn't hold."""
    known = request_snippets(requests, rules)
    named = hits.withColumn("snippet", F.col("hit.snippet"))
    return named.join(known, ["sid", "snippet"], "left_anti").drop("snippet")


def body_hits(bodies: DataFrame, body: str = "body", key: str = "row_id", rules: Rules | None = None, channels: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Commands in the strings of JSON bodies, also within JSON text in tool arguments: key, path, kind, id, label and snippet.

    A string under a key of tool arguments is a tool's at any depth; other strings go by their key. Bodies without any word that
    a rule needs aren't parsed; those with characters as numbers are.
    """
    names = [r[0] for r in (P.COMMANDS if rules is None else rules)]
    if all(n in HINTS for n in names):
        may = F.contains(body, F.lit("\\u"))
        for word in sorted({w.strip("/") for n in names for w in HINTS[n]}):
            may = may | F.contains(F.lower(body), F.lit(word))
        bodies = bodies.where(may)
    tools = F.array(*[F.lit(k) for k in ("arguments", "partial_json", "tool_input", "tool_args", "input_json")])
    found = B.leaves(bodies, body, key).where("kind = 'string'")
    inner = F.when(F.arrays_overlap(F.transform("path", lambda p: F.lower(p)), tools), "arguments").otherwise(F.coalesce("key", F.lit("")))
    plain = T.json_unescaped(F.col("value"))
    seen = found.select(key, "path", channel_kind(inner).alias("kind"), F.when(inner == "arguments", plain).otherwise(F.col("value")).alias("value"))
    return seen.where(F.col("kind").isin(*channels)).withColumn("hit", first_hit(F.col("value"), rules)).where("hit IS NOT NULL").select(key, "path", "kind", "hit.*")


def stream_hits(slots: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Commands in tool arguments that come in fragments: ``slots`` of sid, seq, ord, channel and text are joined by channel, then judged."""
    tool = slots.where(channel_kind(F.col("channel")) == "tool")
    whole = B.channel_texts(tool).withColumn("text", T.json_unescaped(F.col("text")))
    return whole.withColumn("hit", first_hit(F.col("text"), rules)).where("hit IS NOT NULL").select("sid", "channel", "hit.*")


def redistributed(fragments: DataFrame, texts: DataFrame) -> DataFrame:
    """``fragments`` (sid, channel, seq, text) with the session's new text of the channel (``texts``: sid, channel, new) dealt over them by their old lengths; the last takes the rest."""
    order = Window.partitionBy("sid", "channel").orderBy("seq")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    last = F.lead("seq").over(order).isNull()
    dealt = fragments.withColumn("_before", before).withColumn("_last", last).join(texts, ["sid", "channel"])
    size = F.when(F.col("_last"), F.length("new")).otherwise(F.length("text"))
    return dealt.select("sid", "channel", "seq", F.substr(F.col("new"), F.col("_before") + 1, size).alias("text"))
