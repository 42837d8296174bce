"""JSON bodies and streams: leaves, masking by spans, restoring, protocol fields, slots, duplicate keys and decompression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frames, udfs
from ..functions.detectors import RULES
from ..functions.masking import PLACEHOLDER, Settings
from ..operators import bodies as B
from ..operators import masking
from .detector_queries import find_sql

KEY = "test-key"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


PHONE_SQL = "'139' || lpad(CAST(conv_id * 100 + turn AS VARCHAR), 8, '0')"


def _phone():
    return F.concat(F.lit("139"), F.lpad((F.col("conv_id") * 100 + F.col("turn")).cast("string"), 8, "0"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat request around the whole text of each conversation turn, with a mobile number after it and in an argument."""
    message = F.struct(F.col("role"), F.concat("text", F.lit(" call "), _phone()).alias("content"))
    inner = F.to_json(F.struct(_phone().alias("phone"), F.col("turn").alias("n")))
    body = F.to_json(F.struct(F.lit("gamma").alias("model"), F.lit(9).alias("max_tokens"), F.array(message).alias("messages"), F.struct(F.col("turn").alias("id"), inner.alias("arguments")).alias("input")))
    return _conversations(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), body.alias("body"))


def leaf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaves of all bodies, and whether each is exempt."""
    found = B.leaves(bodies(spark, sf_dir)).where("kind <> 'key'")
    return found.select("row_id", "key", "parent", "depth", "kind", "in_business", "exempt", F.sha2("value", 256).alias("digest"))


def tree_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with the mobile numbers of leaves that are not exempt replaced by tokens, also within JSON in arguments."""
    masked = masking.mask_bodies(bodies(spark, sf_dir).withColumnRenamed("body", "text"), Settings(rules=frozenset(["det18_mobile"])), KEY)
    return masked.select("row_id", "status", F.regexp_count("text", F.lit(PLACEHOLDER)).cast("long").alias("n_tokens"), F.size("hits").cast("long").alias("n_values"), (F.try_parse_json("text").isNotNull()).alias("valid"))


def tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies masked by all rules that are on and restored: byte by byte as they were."""
    source = bodies(spark, sf_dir).withColumnRenamed("body", "text")
    masked, mapping = masking.mask_apart(source, Settings(), KEY, json=True)
    back = masking.restore_bodies(masked, mapping)
    return back.select("row_id", (F.col("text") == F.col("before")).alias("same"), "unresolved")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocol, model, stream flag and dialog of request bodies of each protocol."""
    conv = _conversations(spark, sf_dir)
    message = F.array(F.struct("role", F.col("text").alias("content")))
    kinds = [
        F.to_json(F.struct(F.lit("m").alias("model"), message.alias("messages"), F.lit(True).alias("stream"))),
        F.to_json(F.struct(F.lit("m").alias("model"), F.lit("2023-06-01").alias("anthropic_version"), message.alias("messages"))),
        F.to_json(F.struct(F.lit("m").alias("model"), F.col("text").alias("input"))),
        F.to_json(F.struct(F.col("text").alias("other"))),
    ]
    body = F.when(F.col("turn") % 4 == 0, kinds[0])
    for k in (1, 2, 3):
        body = body.when(F.col("turn") % 4 == k, kinds[k])
    made = conv.select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), body.alias("body"))
    return B.described(made).select("row_id", "protocol", "model", "stream", F.sha2("dialog", 256).alias("dialog"), (F.col("first_user").isNotNull()).alias("has_user"))


def stream_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request asks for a stream: only by the literal true."""
    flag = F.element_at(F.array(*[F.lit(x) for x in ("true", "false", '"true"', "1", "null")]), (F.length("text") % 5 + 1).cast("int"))
    made = _conversations(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), F.concat(F.lit('{"model":"m","stream":'), flag, F.lit("}")).alias("body"))
    return B.described(made).select("row_id", "stream")


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by all its names and places: characters of a turn as its prompt, the turn's number as its completion."""
    n, k = F.length("text"), F.col("turn")
    prompt, into = F.struct(n.alias("prompt_tokens"), k.alias("completion_tokens")), F.struct(n.alias("input_tokens"), k.alias("output_tokens"))
    shapes = [
        F.struct(prompt.alias("usage")), F.struct(into.alias("usage")), F.struct(F.struct(into.alias("usage")).alias("message")), F.struct(F.struct(prompt.alias("usage")).alias("response")),
        F.struct(F.struct(into.alias("tokens")).alias("meta")), F.struct(F.struct(n.alias("total_tokens")).alias("usage")), F.struct(F.struct((-n).alias("prompt_tokens")).alias("usage")), F.struct(n.alias("usage")),
    ]
    body = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        body = F.when(n % len(shapes) == i, F.to_json(shape)).otherwise(body)
    made = _conversations(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), body.alias("body"))
    return B.usage(made).select("row_id", "prompt", "completion")


def dialog_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log shows of a body: its dialog, or the first 512 characters of what is none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    body = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.col("text"))
    made = docs.select("doc_id", body.alias("body"))
    shown = B.described(made, key="doc_id").select("doc_id", "dialog")
    return made.join(shown, "doc_id", "left").select("doc_id", F.sha2(F.coalesce(F.nullif(F.trim("dialog"), F.lit("")), F.substring("body", 1, 512)), 256).alias("digest"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each turn as deltas of twelve characters, the last with usage, in a chat stream: sid, seq and data."""
    conv = _conversations(spark, sf_dir)
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 12).cast("int")), lambda i: F.substr(F.col("text"), i * 12 + 1, F.lit(12)))
    cut = conv.select(F.concat_ws(":", "conv_id", "turn").alias("sid"), F.posexplode(pieces).alias("seq", "piece"), F.length("text").alias("n"))
    last = F.col("seq") == F.floor(F.col("n") / 12)
    delta = F.struct(F.struct(F.col("piece").alias("content")).alias("delta"), F.when(last, "stop").alias("finish_reason"))
    usage = F.when(last, F.struct(F.col("n").alias("prompt_tokens"), F.lit(3).alias("completion_tokens")))
    return cut.select("sid", "seq", F.to_json(F.struct(F.array(delta).alias("choices"), usage.alias("usage"))).alias("data"))


def slot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of streamed events by channel, joined again, and how many events end their channel."""
    found = B.slots(_events(spark, sf_dir).withColumn("row_id", F.struct("sid", "seq")).select("row_id", "data"))
    flat = found.select("row_id.sid", "row_id.seq", "ord", "channel", "text", "ends")
    texts = B.channel_texts(flat.where("sid IS NOT NULL"), F.sum(F.col("ends").cast("long")).alias("n_ends"))
    digests = texts.select("sid", "channel", F.sha2("text", 256).alias("digest"), "n_ends")
    return digests.withColumn("n_ends", F.sum("n_ends").over(Window.partitionBy("sid")))


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of streamed bodies: the last values above zero."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: F.concat(F.lit("data: "), x["data"])), "\n\n")
    whole = _events(spark, sf_dir).groupBy("sid").agg(lines.alias("body"))
    return B.usage(whole, key="sid").select("sid", "prompt", "completion")


def frames_of_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent streams cut into events: their number and data, the end mark told apart."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "data")))
    body = F.concat(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("event: chunk\r\ndata: "), x["data"])), "\r\n\r\n"), F.lit("\r\n\r\ndata: [DONE]\n\n"))
    whole = _events(spark, sf_dir).groupBy("sid").agg(body.alias("body"))
    data = frames.sse_data(F.col("body"))
    return whole.select("sid", F.size(frames.sse_events(F.col("body"))).cast("long").alias("n_events"), F.size(F.filter(data, lambda x: x == "[DONE]")).cast("long").alias("n_done"), frames.sniffed(F.col("body")).alias("framing"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an object of all words of a text as keys repeats one; every third text is cut off before its end and no JSON."""
    words = F.filter(F.split("text", "[^A-Za-z]+", -1), lambda w: w != "")
    pairs = F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('":{"n":1}'))), ",")
    end = F.when(F.col("turn") % 3 == 2, "").otherwise("}")
    return _conversations(spark, sf_dir).select("conv_id", "turn", udfs.duplicate_keys(F.concat(F.lit("{"), pairs, end)).alias("repeats"))


def decompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies by their encoding, unpacked; what can't be decoded here is null."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    encoding = F.element_at(F.array(*[F.lit(e) for e in ("identity", " GZip", "deflate", "br")]), (F.col("page_id") % 4 + 1).cast("int"))
    packed = udfs.compress_column(F.encode("html", "utf-8"), encoding)
    return pages.select("page_id", F.sha2(udfs.decompress(packed, encoding), 256).alias("digest"))


QUERIES = {
    "jsn_leaves": leaf_rows, "msk06_json_tree": tree_masked, "rst07_tree_round_trip": tree_round_trip, "jsn01_protocol": described, "jsn05_slots": slot_texts, "jsn04_stream_usage": stream_usage, "jsn02_stream_flag": stream_flags, "jsn03_usage": usages, "prj09_dialog_head": dialog_heads,
    "src04_sse_events": frames_of_streams, "src03_duplicate_keys": duplicate_keys, "src08_decompressed": decompressed,
}
_MOBILE = next(r for r in RULES if r.key == "det18_mobile")
_CONV = "SELECT conv_id, turn, role, text, conv_id || ':' || turn AS row_id, " + PHONE_SQL + " AS phone FROM conversations"
ORACLES = {
    "jsn_leaves": f"""
SELECT row_id, key, parent, depth, kind, in_business, exempt, sha256(value) AS digest FROM (
  SELECT row_id, unnest([
    {{'key': 'model', 'parent': NULL, 'depth': 1, 'kind': 'string', 'in_business': FALSE, 'exempt': TRUE, 'value': 'gamma'}},
    {{'key': 'max_tokens', 'parent': NULL, 'depth': 1, 'kind': 'number', 'in_business': FALSE, 'exempt': TRUE, 'value': '9'}},
    {{'key': 'role', 'parent': 'messages', 'depth': 3, 'kind': 'string', 'in_business': FALSE, 'exempt': TRUE, 'value': role}},
    {{'key': 'content', 'parent': 'messages', 'depth': 3, 'kind': 'string', 'in_business': FALSE, 'exempt': FALSE, 'value': text || ' call ' || phone}},
    {{'key': 'id', 'parent': 'input', 'depth': 2, 'kind': 'number', 'in_business': TRUE, 'exempt': FALSE, 'value': CAST(turn AS VARCHAR)}},
    {{'key': 'arguments', 'parent': 'input', 'depth': 2, 'kind': 'string', 'in_business': TRUE, 'exempt': FALSE, 'value': '{{"phone":"' || phone || '","n":' || turn || '}}'}}
  ], recursive := true) FROM ({_CONV}))""",
    "msk06_json_tree": f"SELECT row_id, 'masked' AS status, count(*) + 1 AS n_tokens, count(DISTINCT value) AS n_values, TRUE AS valid FROM ({find_sql(_MOBILE, f"SELECT row_id, '' AS src, text || ' call ' || phone AS text FROM ({_CONV})")}) GROUP BY row_id",
    "rst07_tree_round_trip": f"SELECT row_id, TRUE AS same, CAST(0 AS BIGINT) AS unresolved FROM ({_CONV})",
    "jsn01_protocol": f"""
SELECT row_id, CASE turn % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'responses' ELSE 'unknown' END AS protocol, CASE turn % 4 WHEN 3 THEN '' ELSE 'm' END AS model, turn % 4 = 0 AS stream,
  sha256(CASE WHEN turn % 4 = 3 OR trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN '' WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '…（已截断，原文更长）' ELSE text END) AS dialog, turn % 4 IN (0, 1) AND role = 'user' AS has_user FROM ({_CONV})""",
    "jsn05_slots": f"SELECT row_id AS sid, 'c0.content' AS channel, sha256(text) AS digest, CAST(1 AS BIGINT) AS n_ends FROM ({_CONV})",
    "jsn04_stream_usage": f"SELECT row_id AS sid, length(text)::BIGINT AS prompt, CAST(3 AS BIGINT) AS completion FROM ({_CONV})",
    "src04_sse_events": f"SELECT row_id AS sid, (length(text) // 12 + 2)::BIGINT AS n_events, CAST(1 AS BIGINT) AS n_done, 'sse' AS framing FROM ({_CONV})",
    "jsn02_stream_flag": f"SELECT row_id, length(text) % 5 = 0 AS stream FROM ({_CONV})",
    "jsn03_usage": f"SELECT row_id, CASE WHEN length(text) % 8 <= 5 THEN length(text) ELSE 0 END::BIGINT AS prompt, CASE WHEN length(text) % 8 <= 4 THEN turn ELSE 0 END::BIGINT AS completion FROM ({_CONV})",
    "prj09_dialog_head": r"""
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 1 OR blank THEN left(CASE WHEN doc_id % 2 = 1 THEN text ELSE body END, 512) WHEN length(text) > 8000 THEN trim(left(text, 8000) || chr(10) || '…（已截断，原文更长）', ' ') ELSE trim(text, ' ') END) AS digest
FROM (SELECT doc_id, text, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' AS blank, '{"content":' || to_json(text)::VARCHAR || '}' AS body FROM documents WHERE text IS NOT NULL)""",
    "src03_duplicate_keys": "SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN len(list_distinct(w)) < len(w) END AS repeats FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM conversations)",
    "src08_decompressed": "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN sha256(html) END AS digest FROM pages",
}
