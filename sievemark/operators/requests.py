"""Requests and what becomes of them: admission, headers, sessions, events, traces and the export of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from . import detect

# Limits, methods and headers on which results depend.
BODY_BYTES = 32 << 20
READ_ONLY = ("GET", "HEAD", "OPTIONS")
PLAIN_ENCODINGS, KNOWN_ENCODINGS = ("", "identity"), ("gzip", "x-gzip", "deflate", "br", "zstd")
HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "host", "content-length")
SECRET_HEADERS = (
    "authorization", "proxy-authorization", "cookie", "x-api-key", "api-key", "apikey", "x-goog-api-key", "x-auth-token", "x-access-token", "x-token", "x-session-token", "private-token",
    "x-gitlab-token", "x-github-token", "x-amz-security-token", "x-amz-credential", "x-client-secret", "client-secret",
)
HEADERS_CUT = ("x-shield-truncated", "true")
HEADER_COUNT, HEADER_CHARS, HEADER_BYTES = 100, 2048, 16 << 10
EXPORT_ROWS, EXPORT_BYTES = 5000, 32 << 20


def admitted(requests: DataFrame, fail_closed: bool = True, body_bytes: int = BODY_BYTES) -> DataFrame:
    """``requests`` with type, status and reason of the first rule of admission that applies.

    Columns (null: no): routed, method, paused, encoding, decoded (null: can't be), content_type, body, valid (its JSON), known (its
    shape), failed (masking) and blocked (by a rule). In order: 502 no route, 413 too large, read-only methods pass, paused bypasses,
    415 unknown or undecodable encodings, then other types, invalid JSON and unknown shapes, which are refused or,
    unless ``fail_closed``, bypass; 503 for a failed masking or a rule that blocks; else MASK.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind, encoding = F.lower(F.coalesce("content_type", F.lit(""))), F.lower(F.trim(F.coalesce("encoding", F.lit(""))))
    case = lambda kind_, status, reason: F.struct(F.lit(kind_).alias("type"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    shut = lambda status, reason: case("BLOCK", status, reason) if fail_closed else case("BYPASS", 200, reason)
    verdict = (
        F.when(~yes("routed"), case("BLOCK", 502, "no_reverse_route"))
        .when(F.octet_length(F.coalesce("body", F.lit(""))) > body_bytes, case("BLOCK", 413, "too_large"))
        .when(F.upper("method").isin(*READ_ONLY), case("PASS", 200, "readonly_method"))
        .when(yes("paused"), case("BYPASS", 200, "filter_disabled"))
        .when(~encoding.isin(*PLAIN_ENCODINGS, *KNOWN_ENCODINGS) | (encoding.isin(*KNOWN_ENCODINGS) & ~yes("decoded")), case("BLOCK", 415, "unsupported_encoding"))
        .when(~kind.contains("json"), shut(503, "non_json"))
        .when(~yes("valid"), shut(400, "invalid_json"))
        .when(~yes("known") & F.lit(not fail_closed), case("BYPASS", 200, "unknown_shape"))
        .when(yes("failed"), case("BLOCK", 503, "pipeline"))
        .when(yes("blocked"), case("BLOCK", 503, "rule_block"))
        .otherwise(case("MASK", 200, ""))
    )
    return requests.withColumn("verdict", verdict).select(*[c for c in requests.columns if c not in ("type", "status", "reason")], "verdict.*")


def forwarded(headers: Column) -> Column:
    """Headers (array of name and value) that may go on: none of the hop's own; repeated ones all stay."""
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*HOP_HEADERS))


def logged_headers(rows: DataFrame, headers: str = "headers", key: str = "row_id", plain: bool = False) -> DataFrame:
    """Headers for the log: names in lower case, at most 100 of at most 2048 characters and 16 KiB in all, credentials as stars.

    Where any go beyond the limits, a last entry says so; ``plain`` keeps credentials. Each list is worked on within its row, and a
    row without headers has none in the log.
    """
    value = lambda h: F.when(F.lower(h["name"]).isin(*SECRET_HEADERS) & ~F.lit(plain), "***").when(F.octet_length(h["value"]) > HEADER_CHARS, F.concat(T.truncated(h["value"], HEADER_CHARS), F.lit("…"))).otherwise(h["value"])
    first = lambda all_: F.transform(F.slice(all_, 1, HEADER_COUNT), lambda h: F.struct(F.lower(h["name"]).alias("name"), value(h).alias("value")))
    size = lambda a, h: a["size"] + F.coalesce(F.octet_length(h["name"]) + F.octet_length(h["value"]), F.lit(0))
    none = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("fit"))
    fit = lambda shown: F.aggregate(shown, none, lambda a, h: F.struct(size(a, h).alias("size"), F.when(size(a, h) <= HEADER_BYTES, a["fit"] + 1).otherwise(a["fit"]).alias("fit")), lambda a: a["fit"])
    more = lambda cut: F.when(cut, F.array(F.struct(F.lit(HEADERS_CUT[0]).alias("name"), F.lit(HEADERS_CUT[1]).alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    logged = lambda all_: T.named(first(all_), lambda shown: T.named(fit(shown), lambda k: F.concat(F.slice(shown, F.lit(1), k), more(F.size(all_) > k))))
    return rows.select(key, F.explode(F.transform(F.filter(F.array(headers), lambda all_: F.size(all_) > 0), logged)).alias("headers"))


def session_id(address: Column, content: Column, nonce: Column) -> Column:
    """16 hexadecimal digits of address and first user message (as JSON), then the nonce: stable within a conversation, unique a request."""
    return F.concat(F.substring(F.sha2(F.concat(address, content), 256), 1, 16), F.lit("-"), nonce)


def items(hits: DataFrame, most: int = 30) -> DataFrame:
    """Up to ``most`` items of each session (sid, label, value, hit): this request's first, each kind by value; credentials only as preview and digest."""
    order = Window.partitionBy("sid").orderBy(F.when(F.col("hit"), 0).otherwise(1), "value", "label")
    secret = F.col("label").isin(*detect.CREDENTIALS)
    return (
        hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
        .select(
            "sid", "label", "hit", F.when(~secret, F.col("value")).alias("original"), secret.alias("cred"), T.digest(F.col("value")).alias("digest"),
            F.when(secret, T.credential_preview(F.col("value"), F.col("label"))).otherwise(T.preview(F.col("value"))).alias("preview"), F.length("value").cast("long").alias("length"),
        )
    )


def restore_items(mapping: DataFrame, restored: DataFrame, most: int = 30) -> DataFrame:
    """Items of what a session's responses may restore: of ``mapping`` (sid, label, value, token) the first ``most`` values, in order, each with whether ``restored`` (sid, token) has its token.

    Credentials keep a digest in the place of the value. A value that a session holds by several labels has the least.
    """
    used = restored.select("sid", "token").distinct().withColumn("_used", F.lit(True))
    once = mapping.where("value <> ''").groupBy("sid", "value").agg(F.min(F.struct("label", "token")).alias("m")).select("sid", "value", "m.*")
    order = Window.partitionBy("sid").orderBy("value")
    first = once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    secret = F.col("label").isin(*detect.CREDENTIALS)
    return first.join(used, ["sid", "token"], "left").select("sid", F.col("_r").alias("ord"), "label", "token", F.when(~secret, F.col("value")).alias("original"), T.digest(F.col("value")).alias("digest"), F.coalesce("_used", F.lit(False)).alias("restored"))


def mask_events(requests: DataFrame, hits: DataFrame, plain: bool = False) -> DataFrame:
    """A MASK event for each request (sid, dialog, masked_dialog, warned, warned_labels): count of hits, distinct originals, items; dialogs are redacted unless ``plain``."""
    counted = hits.groupBy("sid").agg(F.count_if("hit").alias("count"), F.countDistinct("value").alias("masked_total"))
    listed = items(hits).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("hit", "original", "label", "digest", "preview", "length", "cred")), asc=False).alias("items"))
    shown = lambda c: F.col(c) if plain else detect.redact(F.col(c))
    return requests.join(counted, "sid", "left").join(listed, "sid", "left").select(
        "sid", F.lit("MASK").alias("type"), shown("dialog").alias("dialog"), "masked_dialog", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("masked_total", F.lit(0)).alias("masked_total"), "items", "warned", "warned_labels"
    )


def restore_status(blocked: Column, restored: Column, unresolved: Column) -> Column:
    return F.when(blocked, "blocked").when(unresolved > 0, "unresolved").when(restored > 0, "restored").otherwise("no_sensitive_data")


def restore_events(responses: DataFrame) -> DataFrame:
    """A RESTORE event for each response (sid, blocked, restored, unresolved, samples, first_byte_ms, upstream_ms): status, counts and times above zero."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return responses.select("sid", F.lit("RESTORE").alias("type"), restore_status(F.col("blocked"), F.col("restored"), F.col("unresolved")).alias("restore_status"), "restored", "unresolved", F.slice("samples", 1, 5).alias("samples"), positive("first_byte_ms"), positive("upstream_ms"))


def scan_events(values: DataFrame) -> DataFrame:
    """A SCANWARN event for each session with new sensitive values (sid, label, value): previews by label; sessions without any have none."""
    secret = F.col("label").isin(*detect.CREDENTIALS)
    shown = F.when(secret, T.credential_preview(F.col("value"), F.col("label"))).otherwise(T.preview(F.col("value")))
    return values.select("sid", "label", shown.alias("preview")).groupBy("sid").agg(F.lit("SCANWARN").alias("type"), F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(F.struct("label", "preview"))).alias("items"))


def traces(bodies: DataFrame, keep: int = 20, each_bytes: int = 32 << 20, plain: bool = True) -> DataFrame:
    """``bodies`` (sid, kind, primary_body, secondary_body) as traces: both cut to ``each_bytes`` with their sizes before; none unless ``plain`` and ``keep`` > 0."""
    gate = bodies if plain and keep > 0 else bodies.where(F.lit(False))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    cut = lambda c: T.truncated(F.col(c), each_bytes)
    return gate.select(
        "sid", "kind", cut("primary_body").alias("primary_body"), cut("secondary_body").alias("secondary_body"), size("primary_body").alias("primary_bytes"), size("secondary_body").alias("secondary_bytes"),
        ((size("primary_body") > each_bytes) | (size("secondary_body") > each_bytes)).alias("truncated"),
    )


def rendered(found: DataFrame) -> DataFrame:
    """sid and a readable text of both halves of each trace (rows of sid, kind req or resp, primary_body, secondary_body, primary_bytes), in four sections."""
    half = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    both = found.groupBy("sid").agg(*[half(k, c).alias(f"{k}_{c[:3]}") for k in ("req", "resp") for c in ("primary_body", "secondary_body")], *[half(k, "primary_bytes").alias(f"{k}_bytes") for k in ("req", "resp")])
    part = lambda name, body, n: F.concat(F.lit(f"== {name} "), F.coalesce(F.concat(F.lit("("), T.human_bytes(F.col(n)), F.lit(")")), F.lit("(none)")), F.lit("\n"), F.coalesce(body, F.lit("")))
    return both.select("sid", F.concat_ws("\n\n", part("request", F.col("req_pri"), "req_bytes"), part("masked request", F.col("req_sec"), "req_bytes"), part("response", F.col("resp_pri"), "resp_bytes"), part("restored response", F.col("resp_sec"), "resp_bytes")).alias("text"))


def exported(events: DataFrame, payload: str = "payload", rows: int = EXPORT_ROWS, most_bytes: int = EXPORT_BYTES) -> DataFrame:
    """The newest events (id, payload), redacted, at most ``rows`` and ``most_bytes``; truncated says whether any were left out."""
    newest = events.select("id", detect.redact(F.col(payload)).alias("payload")).orderBy(F.desc("id")).limit(rows + 1)
    order = Window.orderBy(F.desc("id"))  # over at most rows + 1
    sized = newest.withColumn("_r", F.row_number().over(order)).withColumn("_sum", F.sum(F.octet_length("payload") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("_r") <= rows) & (F.col("_sum") <= most_bytes)
    return sized.withColumn("truncated", F.max(~fits).over(Window.partitionBy())).where(fits).select("id", "payload", "truncated")
