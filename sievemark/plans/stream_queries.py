"""Queries of responses that come in pieces: guarded, restored whole, decoded, kept; and of mappings over time. The SQL knows only the whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.detectors import RULES
from ..functions.masking import Settings
from ..operators import decoding, masking, responses
from ..operators.tables import spread
from ..streaming import commands, mapping
from .detector_queries import find_sql
from .json_queries import _CONV, KEY, _conversations, _phone
from .signal_queries import _rewritten_sql
from .signal_queries import responses as texts
from .signal_queries import responses_sql as texts_sql

_MASKED = [r for r in RULES if r.key in ("det18_mobile", "det19_email")]


def _cut(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, cut in one pass over the text; an empty text is one empty piece."""
    return F.when(text != "", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(text))


def _pieces(spark: SparkSession, sf_dir: str, size: int = 37) -> DataFrame:
    """Every text as tool arguments in pieces: sid, channel, seq, text and final."""
    rows = texts(spark, sf_dir).where("text IS NOT NULL")
    cut = rows.select(F.col("row_id").alias("sid"), F.posexplode(_cut(F.col("text"), size)).alias("seq", "text"), F.greatest(F.floor((F.length("text") - 1) / size), F.lit(0)).alias("last"))
    return cut.select("sid", F.lit("c0.tool0").alias("channel"), F.col("seq").cast("long").alias("seq"), "text", (F.col("seq") == F.col("last")).alias("final"))


def _joined(rows: DataFrame) -> DataFrame:
    """sid and the joined text of all its pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return rows.groupBy("sid").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which commands were rewritten while they passed in pieces, each joined again."""
    whole = commands.guard_pieces(_pieces(spark, sf_dir), commands.How("rewrite"), joined=True)
    return whole.where("hit").select("sid", F.sha2("text", 256).alias("digest"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


#: By the turn modulo 7: protocol and channel of the response.
SHAPES = ["c0.content", "c0.tool1", "a0.text", "a1.pj", "r0.text@m1", "r1.args@f1", "o.message.content"]


def response_bodies(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Streamed responses (row_id, content_type, text, and other columns) of ``rows`` (row_id, turn, text, ...), cut every nine characters: chat, blocks, response items and lines of JSON, as text or as tool arguments."""
    kind = F.pmod("turn", F.lit(len(SHAPES)))
    tool = kind.isin(1, 3, 5)
    whole = F.when(tool, F.to_json(F.struct(F.col("text").alias("q")))).otherwise(F.col("text"))
    cut = _cut(F.col("whole"), 9)
    lit = F.lit
    delta = lambda d: _json(choices=F.array(_struct(index=lit(0), delta=d)))
    block = lambda n, d: _json(type=lit("content_block_delta"), index=lit(n), delta=d)
    made = [
        (lambda p: delta(_struct(content=p)), [_json(choices=F.array(_struct(index=lit(0), finish_reason=lit("stop")))), "[DONE]"]),
        (lambda p: delta(_struct(tool_calls=F.array(_struct(index=lit(1), function=_struct(arguments=p))))), [_json(choices=F.array(_struct(index=lit(0), finish_reason=lit("tool_calls")))), "[DONE]"]),
        (lambda p: block(0, _struct(type=lit("text_delta"), text=p)), [_json(type=lit("content_block_stop"), index=lit(0)), _json(type=lit("message_stop"))]),
        (lambda p: block(1, _struct(type=lit("input_json_delta"), partial_json=p)), [_json(type=lit("content_block_stop"), index=lit(1)), _json(type=lit("message_stop"))]),
        (lambda p: _json(type=lit("response.output_text.delta"), item_id=lit("m1"), output_index=lit(0), content_index=lit(0), delta=p), [_json(type=lit("response.completed"))]),
        (lambda p: _json(type=lit("response.function_call_arguments.delta"), item_id=lit("f1"), output_index=lit(1), delta=p), [_json(type=lit("response.completed"))]),
        (lambda p: _json(message=_struct(role=lit("assistant"), content=p), done=lit(False)), [_json(done=lit(True))]),
    ]
    body = F.lit(None).cast("string")
    for k, (event, ends) in enumerate(made):
        frames_ = F.concat(F.transform(cut, event), F.array(*[lit(e) if isinstance(e, str) else e for e in ends]))
        lines = F.array_join(frames_, "\n") if k == 6 else F.array_join(F.transform(frames_, lambda x: F.concat(lit("data: "), x)), "\r\n\r\n")
        body = F.when(kind == k, F.concat(lines, lit("\n" if k == 6 else "\r\n\r\n"))).otherwise(body)
    content_type = F.when(kind == 6, "application/x-ndjson").otherwise("text/event-stream; charset=utf-8")
    others = [c for c in rows.columns if c not in ("row_id", "turn", "text")]
    return rows.withColumn("whole", whole).select("row_id", content_type.alias("content_type"), body.alias("text"), *others)


def spread_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, turn and text of all turns, with a number, dealt over all tasks: their file may be one, and each becomes many events."""
    rows = spread(_conversations(spark, sf_dir), "conv_id", "turn")
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), "turn", F.concat("text", F.lit(" call "), _phone()).alias("text"))


def whole_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts of all turns, streamed in four protocols and restored as whole bodies: each channel's text as it was, and counts."""
    turns = spread_turns(spark, sf_dir).withColumn("before", F.col("text"))
    settings = Settings(rules=frozenset(r.key for r in _MASKED))
    known = masking.tokens(masking.found(masking.mask(turns, settings, KEY)), KEY)
    masked = masking.mask(turns, settings, KEY, known)  # the same again, which takes far less than writing or restoring it
    bodies = response_bodies(spark, sf_dir, masked.select("row_id", "turn", "text", "hits", "before"))
    back = responses.restore_bodies(bodies, known, own_hits=True)
    return channel_digests(back)


def channel_digests(bodies: DataFrame) -> DataFrame:
    """row_id, channel, digest of each channel's text, and the counts of restored ``bodies``, which are made once."""
    found = responses.slots(bodies, ("restored", "unresolved")).where("NOT snapshot")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "ord", "text")))
    channels = found.groupBy("row_id", "channel", "restored", "unresolved").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))
    plain = F.when(F.col("channel").isin(*[SHAPES[k] for k in (1, 3, 5)]), F.get_json_object("text", "$.q")).otherwise(F.col("text"))
    return channels.select("row_id", "channel", F.sha2(plain, 256).alias("digest"), "restored", "unresolved")


def chunked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed by their number's encoding, cut into chunks of 59 bytes and decoded chunk by chunk."""
    encoding = F.element_at(F.array(*[F.lit(e) for e in ("identity", "gzip", " Deflate", "br")]), (F.col("page_id") % 4 + 1).cast("int"))
    packed = udfs.compress_column(F.encode("html", "utf-8"), encoding)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("sid"), encoding.alias("encoding"), packed.alias("body"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.octet_length("body") - 1) / 59), F.lit(0)).cast("int"))
    cut = pages.select("sid", "encoding", F.posexplode(F.transform(starts, lambda i: F.substr(F.col("body"), i * 59 + 1, F.lit(59)))).alias("seq", "chunk"))
    out = decoding.decoded_chunks(cut.withColumn("seq", F.col("seq").cast("long")))
    status = out.groupBy("sid").agg(F.max_by("status", "seq").alias("status"))
    return _joined(out).join(status, "sid").select("sid", F.sha2("text", 256).alias("digest"), "status")


def kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 256 KiB of all documents of each source, in the order of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("sid"), F.col("doc_id").alias("seq"), F.lit(0).alias("ord"), "text")
    return responses.kept_texts(docs).select("sid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))


#: Seconds that the queries on mappings let one live after its last use, and the moment that they look at.
LIVE_S, CLOCK = 86_400, "2024-01-20 12:00:00"


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a use of its user's address: event_id, label, value, token and ts."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.concat(F.lit("u"), F.col("user_id"), F.lit("@mail.example.com"))
    return log.select("event_id", F.lit("EMAIL").alias("label"), value.alias("value"), masking.token(F.lit("EMAIL"), value, KEY).alias("token"), "ts")


def live_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings that live at one moment, since when, and how often they were used."""
    got = mapping.live_at(_uses(spark, sf_dir), F.lit(CLOCK).cast("timestamp"), LIVE_S)
    return got.select("value", F.unix_micros("born").alias("born"), F.unix_micros("touched").alias("touched"), "uses")


def all_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lifetimes of all mappings, each until no use came for an hour."""
    got = mapping.lifetimes(_uses(spark, sf_dir), 3600)
    return got.select("value", F.unix_micros("born").alias("born"), F.unix_micros("touched").alias("touched"), "uses")


def warm_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 mappings of the log; every fifth event has a placeholder for its value, every seventh none."""
    dirty = F.when(F.col("event_id") % 5 == 0, F.col("token")).when(F.col("event_id") % 7 == 0, "").otherwise(F.col("value"))
    return mapping.warm_start(_uses(spark, sf_dir).withColumn("value", dirty), 100).select("value", "rank")


def _lives_sql(ttl_s: int, where: str = "TRUE") -> str:
    return f"""
SELECT value, epoch_us(min(ts)) AS born, epoch_us(max(ts)) AS touched, count(*) AS uses, row_number() OVER (PARTITION BY value ORDER BY max(ts) DESC) AS back FROM (
  SELECT *, sum(new) OVER (PARTITION BY value ORDER BY ts, event_id) AS life FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY value ORDER BY ts, event_id) <= {ttl_s}000000 THEN 0 ELSE 1 END AS new
    FROM (SELECT event_id, ts, 'u' || user_id || '@mail.example.com' AS value FROM events WHERE {where})))
GROUP BY value, life"""


_TURNS = f"SELECT row_id, '' AS src, text || ' call ' || phone AS text FROM ({_CONV})"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cmd08_guarded_stream": guarded, "rst08_whole_responses": whole_responses, "src10_chunked_bodies": chunked_bodies, "stm10_kept_texts": kept_texts,
    "stm08_live_mappings": live_mappings, "map02_lifetimes": all_lifetimes, "map02_warm_start": warm_mappings,
}
ORACLES = {
    "cmd08_guarded_stream": f"SELECT row_id AS sid, sha256({_rewritten_sql('text')}) AS digest FROM ({texts_sql()}) WHERE text IS NOT NULL AND {_rewritten_sql('text')} <> text",
    "rst08_whole_responses": f"""
SELECT c.row_id, [{', '.join(f"'{s}'" for s in SHAPES)}][turn % {len(SHAPES)} + 1] AS channel, sha256(text || ' call ' || phone) AS digest, n AS restored, CAST(0 AS BIGINT) AS unresolved
FROM ({_CONV}) c JOIN (SELECT row_id, count(*) AS n FROM ({' UNION ALL '.join(f'({find_sql(r, _TURNS)})' for r in _MASKED)}) GROUP BY row_id) h ON c.row_id = h.row_id""",
    "src10_chunked_bodies": "SELECT page_id::VARCHAR AS sid, sha256(CASE WHEN page_id % 4 < 3 THEN html ELSE '' END) AS digest, CASE WHEN page_id % 4 < 3 THEN 'ok' ELSE 'unknown' END AS status FROM pages",
    "stm10_kept_texts": """
WITH d AS (SELECT source AS sid, doc_id, text, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents),
k AS (SELECT sid, doc_id, CASE WHEN b + strlen(text) <= 262144 THEN text ELSE left(text, list_max(list_filter(range(length(text) + 1), lambda n: strlen(left(text, n)) <= 262144 - b))::INT) END AS t FROM d WHERE b < 262144)
SELECT sid, sum(strlen(t))::BIGINT AS n_bytes, sha256(coalesce(string_agg(t, '' ORDER BY doc_id), '')) AS digest FROM k GROUP BY sid""",
    "stm08_live_mappings": f"SELECT value, born, touched, uses FROM ({_lives_sql(LIVE_S, f"ts <= TIMESTAMP '{CLOCK}'")}) WHERE back = 1 AND touched + {LIVE_S}000000 >= epoch_us(TIMESTAMP '{CLOCK}')",
    "map02_lifetimes": f"SELECT value, born, touched, uses FROM ({_lives_sql(3600)})",
    "map02_warm_start": "SELECT value, row_number() OVER (ORDER BY e DESC, value)::INT AS rank FROM (SELECT 'u' || user_id || '@mail.example.com' AS value, max(event_id) AS e FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY 1) QUALIFY rank <= 100",
}
