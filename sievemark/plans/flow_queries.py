"""Queries that run streams to their end, and those of events, traces, bodies and exempt parts. The SQL works on whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames, udfs
from ..functions.masking import Settings
from ..operators import bodies as B
from ..operators import commands, masking, requests
from ..operators.tables import shared_folder
from ..sources.corpus import corpus, corpus_sql
from ..streaming import mapping, restore
from .detector_queries import KEY, find_sql, mask_sql, token_sql
from .json_queries import _CONV, _conversations, _phone
from .signal_queries import _HITS, _hit_sql, _judged, _values_sql, new_values
from .signal_queries import responses as texts
from .signal_queries import responses_sql as texts_sql
from .stream_queries import _MASKED, _lives_sql, channel_digests, response_bodies, spread_turns
from .stream_queries import ORACLES as STREAM_ORACLES

_SETTINGS = Settings(rules=frozenset(r.key for r in _MASKED))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _finished(stream: DataFrame, path: str) -> DataFrame:
    """What a stream has written once it has read all there is."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses of ``rst08_whole_responses`` as a stream of chunks of 50 bytes, restored in state, in all four protocols."""
    masked = masking.mask(spread_turns(spark, sf_dir), _SETTINGS, KEY)
    known = masked.select(F.col("row_id").alias("sid"), F.map_from_entries(F.transform("hits", lambda h: F.struct(h["token"], h["value"]))).alias("known"))
    framing = F.when(F.col("content_type").contains("ndjson"), "ndjson").otherwise("sse")
    bodies = response_bodies(spark, sf_dir, masked.select("row_id", "turn", "text")).select(F.col("row_id").alias("sid"), framing.alias("framing"), F.encode("text", "utf-8").alias("data"))
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / 50).cast("int"))
    cut = bodies.select("sid", "framing", F.size(starts).alias("n"), F.posexplode(F.transform(starts, lambda i: F.substr(F.col("data"), i * 50 + 1, F.lit(50)))).alias("seq", "chunk"))
    path = _folder(spark, "responses")
    rows = cut.select("sid", F.col("seq").cast("long").alias("seq"), "framing", "chunk", (F.col("seq") == F.col("n") - 1).alias("final"))
    rows.write.parquet(f"{path}/in")
    known.write.parquet(f"{path}/known")
    pieces = _finished(restore.restore_frames(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), spark.read.parquet(f"{path}/known"), None), path)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    whole = pieces.groupBy(F.col("sid").alias("row_id")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"), F.sum("restored").alias("restored"), F.sum("unresolved").alias("unresolved"))
    return channel_digests(whole.withColumn("content_type", F.lit("")))


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings that ended, over a stream of the log: six hours after their last use, as far as the watermark knows."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = _folder(spark, "uses")
    value = F.concat(F.lit("u"), F.col("user_id"), F.lit("@mail.example.com"))
    rows = log.select(F.lit("EMAIL").alias("label"), value.alias("value"), F.lit("t").alias("token"), "ts")
    rows.write.parquet(f"{path}/in")
    got = _finished(mapping.expired_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), 21_600), path)
    return got.select("value", F.unix_micros("born").alias("born"), F.unix_micros("touched").alias("touched"), "uses")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended by a stream with its rollup: both by day and type."""
    path = _folder(spark, "log")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    rows.write.parquet(f"{path}/in")
    restore.append_with_rollups(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/log", f"{path}/rollup", f"{path}/state").awaitTermination()
    day = F.to_date("ts")
    logged = spark.read.parquet(f"{path}/log").groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n_log"))
    rolled = spark.read.parquet(f"{path}/rollup").groupBy("day", "event_type").agg(F.sum("count").alias("n_rollup"))
    return logged.join(rolled, ["day", "event_type"], "full").select(F.col("day").cast("string").alias("day"), "event_type", "n_log", "n_rollup")


def body_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands in the JSON text of tool arguments within bodies; the same words in messages are none."""
    rows = texts(spark, sf_dir).where("text IS NOT NULL")
    body = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"), F.struct(F.to_json(F.struct(F.col("text").alias("cmd"))).alias("arguments")).alias("input")))
    return commands.body_hits(rows.select("row_id", body.alias("body"))).select("row_id", "kind", "id")


def hit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.hit_events(commands.record(_judged(spark, sf_dir, "block"))).select("sid", "type", "reason", "count")


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of texts with values that their session doesn't know: how many, and their labels."""
    values = new_values(spark, sf_dir).withColumnRenamed("row_id", "sid")
    return requests.scan_events(values).select("sid", "type", "count", F.array_join(F.transform("items", lambda i: i["label"]), ",").alias("labels"))


def mask_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = masking.mask(corpus(spark, sf_dir).withColumn("dialog", F.col("text")), _SETTINGS, KEY).withColumnRenamed("row_id", "sid")
    hits = masked.select("sid", F.explode("hits").alias("h")).select("sid", "h.label", "h.value", F.lit(True).alias("hit"))
    made = masked.select("sid", "dialog", F.col("text").alias("masked_dialog"), "warned", "warned_labels")
    return requests.mask_events(made, hits).select("sid", "type", F.col("count").cast("long").alias("count"), F.col("masked_total").cast("long").alias("masked_total"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2("masked_dialog", 256).alias("digest"))


def response_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that a response names: in its body, in an event, in an event's message or response, or nowhere."""
    model = F.concat(F.lit("m-"), "role")
    body = (
        F.when(F.col("turn") % 5 == 0, F.to_json(F.struct(model.alias("model"), F.col("text").alias("x"))))
        .when(F.col("turn") % 5 == 1, F.concat(F.lit('data: {"x":1}\n\ndata: '), F.to_json(F.struct(model.alias("model")))))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit("event: a\ndata: "), F.to_json(F.struct(F.struct(model.alias("model")).alias("message")))))
        .when(F.col("turn") % 5 == 3, F.concat(F.lit("data: "), F.to_json(F.struct(F.struct(model.alias("model"), F.col("text").alias("x")).alias("response"))), F.lit("\n")))
        .otherwise(F.col("text"))
    )
    made = _conversations(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), body.alias("body"))
    return B.usage(made).select("row_id", "model")


def valid_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are JSON: objects around them, those of every third length cut off, and the plain texts."""
    n = F.length("text")
    body = F.when(n % 3 == 0, F.concat(F.lit('{"t":'), F.to_json(F.struct("text")))).when(n % 3 == 1, F.to_json(F.struct("text"))).otherwise(F.col("text"))
    return corpus(spark, sf_dir).where("text IS NOT NULL").select("row_id", udfs.json_valid(body).alias("valid"))


def exempt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with a number in the content, in a part that is exempt, and in an id: only the first is masked."""
    call = F.concat(F.lit("call "), _phone())
    message = F.struct(F.col("role"), call.alias("content"), F.struct(F.lit("ephemeral").alias("type"), call.alias("note")).alias("cache_control"))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.array(message).alias("messages"), F.struct(call.alias("encrypted_content")).alias("extra")))
    rows = _conversations(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), body.alias("text"))
    masked = masking.mask_bodies(rows, Settings(), KEY)
    js = lambda p: F.get_json_object("text", p)
    return masked.select("row_id", js("$.messages[0].content").alias("content"), js("$.messages[0].cache_control.note").alias("note"))


def rendered_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of documents as text to read: the request, what it became, and no response."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    made = docs.select(F.col("doc_id").alias("sid"), F.lit("req").alias("kind"), F.col("text").alias("primary_body"), F.translate("text", "ae", "AE").alias("secondary_body"))
    return requests.rendered(requests.traces(made)).select("sid", F.sha2("text", 256).alias("digest"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents that aren't blank."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    found = frames.ndjson_lines(F.col("text"))
    return docs.select("doc_id", F.size(found).cast("long").alias("n_lines"), F.sha2(F.array_join(found, "\n"), 256).alias("digest"))


def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test of settings on all texts: what was found, and that it comes back."""
    back = masking.round_trip(corpus(spark, sf_dir).where("text IS NOT NULL"), _SETTINGS, KEY, changed=True)
    return back.select("row_id", F.size("hits").cast("long").alias("n_values"), "restored", (F.col("restored_text") == F.col("before")).alias("same"))


_FOUND = " UNION ALL ".join(f"(SELECT * FROM ({find_sql(r)}))" for r in _MASKED)
_SIZE = "'(' || CASE WHEN strlen({0}) >= 1048576 THEN printf('%.1f', strlen({0}) / 1048576.0) || ' MiB' ELSE (strlen({0}) // 1024) || ' KiB' END || ')'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stm01_streamed_responses": streamed, "stm08_expired_stream": expired, "snk01_appended_log": appended, "cmd06_body_hits": body_hits, "evt04_command_events": hit_events, "evt03_scan_events": scan_events, "evt01_mask_events": mask_events,
    "prj07_response_models": response_models, "flt04_json_valid": valid_bodies, "flt11_exempt_parts": exempt_parts, "snk06_rendered_traces": rendered_traces, "src05_json_lines": lines, "msk11_isolated_test": isolated,
}
_LATE = "(SELECT epoch_us(max(ts)) // 1000 * 1000 - 60000000 FROM events)"
ORACLES = {
    "stm01_streamed_responses": STREAM_ORACLES["rst08_whole_responses"],
    "stm08_expired_stream": f"SELECT value, born, touched, uses FROM ({_lives_sql(21_600)}) WHERE touched + 21600000001 <= {_LATE}",
    "snk01_appended_log": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_log, count(*)::BIGINT AS n_rollup FROM events GROUP BY ALL",
    "cmd06_body_hits": f"""SELECT row_id, 'tool' AS kind, split_part(hit, '|', 1) AS id FROM (SELECT row_id, {_hit_sql("('{\"cmd\":\"' || text || '\"}')")} AS hit FROM ({texts_sql()}) WHERE text IS NOT NULL) WHERE hit IS NOT NULL""",
    "evt04_command_events": f"SELECT sid, 'CMDHIT' AS type, split_part(hit, '|', 1) || ' ' || split_part(hit, '|', 2) AS reason, 1 AS count FROM ({_HITS}) WHERE hit IS NOT NULL",
    "evt03_scan_events": f"SELECT row_id AS sid, 'SCANWARN' AS type, count(*) AS count, string_agg(label, ',' ORDER BY label) AS labels FROM ({_values_sql()}) GROUP BY row_id",
    "evt01_mask_events": f"""
WITH a AS (SELECT row_id, src, text FROM ({mask_sql(_MASKED[0], corpus_sql())})), b AS (SELECT row_id, text FROM ({mask_sql(_MASKED[1], 'SELECT * FROM a')})),
h AS (SELECT row_id, count(DISTINCT label || value) AS n, count(DISTINCT value) AS m FROM ({_FOUND}) GROUP BY row_id)
SELECT b.row_id AS sid, 'MASK' AS type, coalesce(n, 0) AS count, coalesce(m, 0) AS masked_total, least(coalesce(n, 0), 30) AS n_items, sha256(b.text) AS digest FROM b LEFT JOIN h USING (row_id)""",
    "prj07_response_models": f"SELECT row_id, CASE WHEN turn % 5 < 4 THEN 'm-' || role END AS model FROM ({_CONV})",
    "flt04_json_valid": f"""SELECT row_id, json_valid(CASE length(text) % 3 WHEN 0 THEN '{{"t":' || '{{"text":' || to_json(text)::VARCHAR || '}}' WHEN 1 THEN '{{"text":' || to_json(text)::VARCHAR || '}}' ELSE text END) AS valid FROM ({corpus_sql()}) WHERE text IS NOT NULL""",
    "flt11_exempt_parts": f"SELECT row_id, 'call ' || {token_sql('PHONE', 'phone')} AS content, 'call ' || phone AS note FROM ({_CONV})",
    "snk06_rendered_traces": f"SELECT doc_id AS sid, sha256('== request ' || {_SIZE.format('text')} || chr(10) || text || chr(10) || chr(10) || '== masked request ' || {_SIZE.format('text')} || chr(10) || translate(text, 'ae', 'AE') || chr(10) || chr(10) || '== response (none)' || chr(10) || chr(10) || chr(10) || '== restored response (none)' || chr(10)) AS digest FROM documents WHERE text IS NOT NULL",
    "src05_json_lines": "SELECT doc_id, len(l)::BIGINT AS n_lines, sha256(array_to_string(l, chr(10))) AS digest FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL)",
    "msk11_isolated_test": f"SELECT row_id, count(DISTINCT label || value) AS n_values, count(*) AS restored, TRUE AS same FROM ({_FOUND}) GROUP BY row_id",
}
