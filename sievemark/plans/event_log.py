"""Queries over the event log: rollups, windows, paging, upserts, correlations. Written once for either SQL engine.

The log is derived from the ``events`` table: a request life-cycle event for each row. All aggregates are partial
before they are shuffled; windows are partitioned, never global.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Duck, Spark

TABLES = ("events", "documents", "conversations", "customer", "orders", "benchmark", "pages")


def log(d) -> str:
    """id, ts (seconds), day, type, status, reason, model, sid, cnt, n_items, restored, tokens, severity and payload."""
    day = "date_format(ts, 'yyyy-MM-dd')" if d is Spark else "strftime(ts, '%Y-%m-%d')"
    secs = "CAST(unix_timestamp(ts) AS BIGINT)" if d is Spark else "CAST(floor(epoch(ts)) AS BIGINT)"
    return f"""
SELECT event_id AS id, {secs} AS ts, {day} AS day,
  CASE event_type WHEN 'view' THEN 'MASK' WHEN 'click' THEN 'RESTORE' WHEN 'purchase' THEN 'PASS' WHEN 'signup' THEN 'ALERT' WHEN 'error' THEN 'BLOCK' ELSE CASE WHEN value > 50 THEN 'ALERT' ELSE 'BYPASS' END END AS type,
  CASE WHEN cents % 7 = 0 THEN 503 WHEN cents % 11 = 0 THEN 400 ELSE 200 END AS status,
  CASE WHEN cents % 7 = 0 THEN 'pipeline' WHEN cents % 5 = 0 THEN 'readonly_method' ELSE '' END AS reason,
  CASE user_id % 4 WHEN 0 THEN 'm-large' WHEN 1 THEN 'm-small' WHEN 2 THEN ' ' ELSE NULL END AS model,
  'S' || CAST(user_id AS STRING) AS sid, cents % 9 AS cnt, cents % 4 AS n_items, cents % 5 AS restored, cents % 31 AS mark,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, cents % 100 AS completion_tokens,
  CASE cents % 8 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  event_type AS kind, '{{"id":' || CAST(event_id AS STRING) || ',"type":"' || event_type || '","model":"m' || CAST(user_id % 3 AS STRING) || '","n":' || CAST(user_id AS STRING) || ',"props":' || props || '}}' AS payload
FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS cents FROM events) e"""


def items(d) -> str:
    """One row for each item of an event: label, word, whether it was restored."""
    each = "LATERAL VIEW explode(sequence(1, 3)) x AS k" if d is Spark else ", unnest([1, 2, 3]) x(k)"
    return f"""
SELECT id, ts, day, sid, type, k, CASE (mark + k) % 3 WHEN 0 THEN 'PHONE' WHEN 1 THEN 'EMAIL' ELSE 'CARD' END AS label,
  'w' || CAST((mark * 31 + completion_tokens * 7 + k * 17) % 40 AS STRING) AS word, (completion_tokens + k) % 2 = 0 AS restored FROM (SELECT * FROM log) l {each} WHERE k <= n_items"""


RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"

# Each entry: SQL over the views log and items; {n:…}-style differences are functions of the dialect.
PLAIN = {
    "agg01_daily_counters": """
SELECT day, count(*) AS requests, count(DISTINCT sid) AS distinct_sids, sum(CASE WHEN type = 'MASK' THEN 1 ELSE 0 END) AS mask_events,
  sum(CASE WHEN type = 'MASK' THEN CASE WHEN cnt > 0 THEN cnt ELSE n_items END ELSE 0 END) AS masked_items, sum(CASE WHEN type = 'RESTORE' THEN 1 ELSE 0 END) AS restore_events,
  sum(CASE WHEN type = 'RESTORE' THEN CASE WHEN restored > 0 THEN restored ELSE n_items END ELSE 0 END) AS restored_items, sum(CASE WHEN type = 'ALERT' THEN 1 ELSE 0 END) AS alerts FROM log GROUP BY day""",
    "agg03_daily_words": "SELECT day, label, word, count(*) AS n FROM items WHERE type = 'MASK' GROUP BY day, label, word",
    "agg04_daily_models": "SELECT day, model, count(*) AS n FROM log WHERE trim(coalesce(model, '')) <> '' GROUP BY day, model",
    "agg04_daily_status": "SELECT day, CAST(status AS STRING) AS status, count(*) AS n FROM log GROUP BY day, status UNION ALL SELECT day, reason, count(*) FROM log WHERE reason <> '' GROUP BY day, reason",
    "agg05_daily_tokens": "SELECT day, CASE WHEN trim(coalesce(model, '')) = '' THEN '(unknown)' ELSE model END AS model, sum(prompt_tokens) AS prompt, sum(completion_tokens) AS completion FROM log GROUP BY 1, 2",
    "agg06_audit_high": f"SELECT day, sum(CASE WHEN {RANK} >= 3 THEN 1 ELSE 0 END) AS audit_high, sum(CASE WHEN {RANK} >= 3 AND type = 'ALERT' THEN 1 ELSE 0 END) AS alerts FROM log GROUP BY day",
    "agg07_today_by_label": "SELECT label, count(*) AS n FROM items WHERE type = 'MASK' AND day = (SELECT max(day) FROM log) GROUP BY label",
    "agg08_history": "SELECT day, sum(CASE WHEN type = 'MASK' THEN 1 ELSE 0 END) AS mask, sum(CASE WHEN type = 'RESTORE' THEN 1 ELSE 0 END) AS restore, sum(CASE WHEN type = 'BLOCK' THEN 1 ELSE 0 END) AS block FROM log WHERE day >= '2024-01-10' GROUP BY day",
    "agg09_tokens_by_model": "SELECT coalesce(nullif(trim(model), ''), '(unknown)') AS model, sum(prompt_tokens) AS prompt, sum(completion_tokens) AS completion FROM log GROUP BY 1 ORDER BY prompt DESC, model LIMIT 20",
    "agg10_live_counters": "SELECT type, count(*) AS n FROM log GROUP BY type",
    "agg11_dedupe_findings": "SELECT kind, severity, min(id) AS first_id, count(*) AS n, kind || '/' || severity || CASE WHEN count(*) > 1 THEN ' (x' || CAST(count(*) AS STRING) || ')' ELSE '' END AS evidence FROM log WHERE type = 'ALERT' GROUP BY kind, severity",
    "agg12_passive": f"SELECT sid, max({RANK}) AS worst, count(*) AS total, count(DISTINCT kind) AS kinds FROM log WHERE type = 'ALERT' GROUP BY sid",
    "agg15_warned": "SELECT sid, max(cnt) AS warned, count(DISTINCT label) AS labels FROM (SELECT l.sid, l.cnt, i.label FROM log l JOIN items i ON l.id = i.id) q GROUP BY sid",
    "agg16_distinct_originals": "SELECT sid, count(DISTINCT word) AS masked_total, count(*) - count(DISTINCT word) AS reused FROM items GROUP BY sid",
    "agg17_total": "SELECT count(*) AS n FROM log WHERE type = 'MASK'",
    "agg18_id_watermark": "SELECT greatest(max(id), max(prompt_tokens), (SELECT max(id) FROM items)) + 1 AS next_id FROM log",
    "agg20_mapping_count": "SELECT count(DISTINCT label || '|' || word) AS n FROM items",
    "win01_regress": "SELECT sid, min(id) AS first_id FROM (SELECT sid, id, completion_tokens, lag(completion_tokens) OVER (PARTITION BY sid ORDER BY id) AS before FROM log) q WHERE completion_tokens < before GROUP BY sid",
    "win02_input_changes": "SELECT sid, count(*) AS n FROM (SELECT sid, prompt_tokens, first_value(prompt_tokens) OVER (PARTITION BY sid ORDER BY id) AS first_tokens FROM log) q WHERE prompt_tokens <> first_tokens GROUP BY sid",
    "win03_latest_sessions": "SELECT sid, max(id) AS last_id FROM log GROUP BY sid ORDER BY last_id DESC LIMIT 50",
    "win05_newest_mappings": "SELECT label, word, last_id FROM (SELECT label, word, max(id) AS last_id FROM items GROUP BY label, word) q ORDER BY last_id DESC, label, word LIMIT 40",
    "win06_first_five": "SELECT sid, id, label, word, k FROM (SELECT sid, id, label, word, k, row_number() OVER (PARTITION BY sid ORDER BY id, k) AS r FROM items) q WHERE r <= 5",
    "win07_one_hit_per_kind": f"SELECT sid, kind, id FROM (SELECT sid, kind, id, row_number() OVER (PARTITION BY sid, kind ORDER BY {RANK} DESC, id) AS r FROM log WHERE type = 'ALERT') q WHERE r = 1",
    "win09_occurrence": "SELECT id, label, k, row_number() OVER (PARTITION BY id, label ORDER BY k) AS occurrence FROM items",
    "srt01_page": "SELECT id, ts, type, sid FROM log ORDER BY id DESC LIMIT 200 OFFSET 400",
    "srt02_top_words": "SELECT label, word, count(*) AS n FROM items GROUP BY label, word ORDER BY n DESC, label, word LIMIT 50",
    "srt03_top_models": "SELECT model, sum(prompt_tokens + completion_tokens) AS tokens FROM log WHERE trim(coalesce(model, '')) <> '' GROUP BY model ORDER BY tokens DESC, model LIMIT 5",
    "srt06_page_clamp": "SELECT CAST(floor((count(*) - 1) / 200) * 200 AS BIGINT) AS page_start FROM log",
    "set01_union_pages": "SELECT id, type, 'ring' AS held FROM (SELECT id, type FROM log WHERE status = 200 ORDER BY id DESC LIMIT 60) r UNION ALL SELECT p.id, p.type, 'page' FROM (SELECT id, type FROM log ORDER BY id DESC LIMIT 200) p LEFT ANTI JOIN (SELECT id FROM log WHERE status = 200 ORDER BY id DESC LIMIT 60) r ON p.id = r.id",
    "set02_union_labels": "SELECT DISTINCT sid, label FROM (SELECT sid, label FROM items WHERE type = 'MASK' UNION SELECT sid, label FROM items WHERE type = 'RESTORE') q",
    "set05_difference": "SELECT DISTINCT word FROM items WHERE type = 'MASK' EXCEPT SELECT DISTINCT word FROM items WHERE type = 'RESTORE' AND restored",
    "jon01_value_to_token": "SELECT i.id, i.k, i.word, m.first_id, c.first_id AS custom_id, coalesce(c.first_id, m.first_id) AS token_id FROM items i LEFT JOIN (SELECT label, word, min(id) AS first_id FROM items GROUP BY label, word) m ON i.label = m.label AND i.word = m.word LEFT JOIN (SELECT word, min(id) AS first_id FROM items WHERE label = 'CARD' GROUP BY word) c ON i.word = c.word",
    "jon02_token_to_original": "SELECT i.id, i.k, m.word AS orig FROM items i LEFT JOIN (SELECT label, word, max(ts) AS created FROM items GROUP BY label, word) m ON i.label = m.label AND i.word = m.word AND i.ts >= m.created - 86400",
    "jon04_unique_suffix": "SELECT i.id, i.k, u.label FROM items i JOIN (SELECT label || word AS word, min(label) AS label FROM items GROUP BY label || word HAVING count(DISTINCT label) = 1) u ON i.label || i.word = u.word AND i.label = u.label",
    "jon05_request_response": "SELECT sid, max(CASE WHEN type = 'MASK' THEN id END) AS request_id, max(CASE WHEN type = 'RESTORE' THEN id END) AS response_id, sum(CASE WHEN type = 'MASK' THEN prompt_tokens ELSE 0 END) AS request_bytes FROM log GROUP BY sid",
    "jon06_model_mismatch": "SELECT a.sid, a.id, a.kind AS asked, b.kind AS got FROM (SELECT sid, id, kind, lead(id) OVER (PARTITION BY sid ORDER BY id) AS answer FROM log) a JOIN log b ON a.answer = b.id WHERE a.kind <> b.kind",
    "jon07_echo_anti": "SELECT DISTINCT i.sid, i.word FROM items i WHERE i.type = 'RESTORE' AND NOT EXISTS (SELECT 1 FROM items q WHERE q.type = 'MASK' AND q.sid = i.sid AND q.word = i.word)",
    "jon09_leaks_less_known": "SELECT i.id, i.k, i.label, i.word FROM items i LEFT ANTI JOIN (SELECT sid, word FROM items WHERE type = 'MASK') m ON i.sid = m.sid AND i.word = m.word WHERE i.type = 'PASS'",
    "jon15_seeded": "SELECT i.id, i.k FROM items i JOIN (SELECT label, word, min(ts) AS first_ts FROM items WHERE type = 'MASK' GROUP BY label, word) m ON i.label = m.label AND i.word = m.word WHERE i.type = 'RESTORE' AND i.ts > m.first_ts AND i.ts <= m.first_ts + 86400",
    "jon14_fresh_events": "SELECT id, type FROM log WHERE id > (SELECT max(id) - 25 FROM log)",
    "snk03_mapping_upsert": "SELECT label, word, last_id, first_ts FROM (SELECT label, word, id AS last_id, min(ts) OVER (PARTITION BY label, word) AS first_ts, row_number() OVER (PARTITION BY label, word ORDER BY id DESC, k DESC) AS r FROM items) q WHERE r = 1",
    "snk04_trace_upsert": "SELECT sid, type, id, ts, status FROM (SELECT sid, type, id, ts, status, row_number() OVER (PARTITION BY sid, type ORDER BY id DESC) AS r FROM log WHERE type IN ('MASK', 'RESTORE')) q WHERE r = 1",
    "prj12_items_hits_first": "SELECT sid, id, k, label, word FROM (SELECT sid, id, k, label, word, row_number() OVER (PARTITION BY sid ORDER BY CASE WHEN restored THEN 0 ELSE 1 END, word, id, k) AS r FROM items) q WHERE r <= 30",
    "prj03_point_lookup": "SELECT id, payload FROM log WHERE id = 77",
    "prj04_audit_scan": "SELECT id, severity, kind FROM log WHERE type = 'ALERT' ORDER BY id DESC LIMIT 100",
    "prj05_has_trace": "SELECT count(*) > 0 AS found FROM log WHERE sid = 'S8'",
    "flt01_type": "SELECT l.id, w.label FROM log l JOIN (SELECT DISTINCT label FROM items) w ON lower(l.type) = lower(trim(CASE w.label WHEN 'CARD' THEN ' mask' WHEN 'EMAIL' THEN 'Block ' ELSE w.label END))",
    "flt02_search": "SELECT id FROM log WHERE lower(payload) LIKE '%\"n\":1%'",
    "flt03_search_fields": "SELECT id FROM log WHERE type LIKE '%LO%' OR reason LIKE '%pipe%' OR sid LIKE '%S7%' OR payload LIKE '%m2%' OR kind LIKE '%urch%' OR model LIKE '%large%' OR severity LIKE '%CRIT%' OR id IN (SELECT id FROM items WHERE word LIKE '%w39%')",
    "flt05_audit_list": "SELECT id FROM log WHERE severity = 'HIGH' AND lower(kind || ' ' || sid) LIKE '%error%'",
    "flt06_severity_floor": f"SELECT id, severity FROM log WHERE type = 'ALERT' AND ({RANK} >= 3 OR kind = 'error')",
    "flt09_allow_list": "SELECT id, k, word FROM items WHERE lower(trim(word)) NOT IN ('w1', 'w2', 'w3')",
    "flt16_gates": "SELECT id, kind IN ('view', 'click') AS readonly, payload LIKE '{%' AS json FROM log",
    "src13_events_newest": "SELECT id, ts, payload FROM log ORDER BY id DESC LIMIT 100 OFFSET 50",
    "src14_mappings_unexpired": "SELECT label, word, max(ts) AS created FROM items GROUP BY label, word HAVING max(ts) + 86400 > 1706600000 ORDER BY created DESC, label, word LIMIT 25",
    "dte01_retention": "SELECT day, count(*) AS n FROM log WHERE ts >= 1706600000 - 7 * 86400 GROUP BY day",
    "rst09_status": "SELECT sid, CASE WHEN max(CASE WHEN type = 'BLOCK' THEN 1 ELSE 0 END) = 1 THEN 'blocked' WHEN sum(cnt) > 0 THEN 'unresolved' WHEN sum(restored) > 0 THEN 'restored' ELSE 'no_sensitive_data' END AS status FROM log GROUP BY sid",
    "map02_unexpired": "SELECT label, word, ts FROM (SELECT label, word, ts, row_number() OVER (PARTITION BY label, word ORDER BY ts DESC, id DESC, k DESC) AS r FROM items) q WHERE r = 1 AND ts + 86400 > 1706600000",
    "jon03_unwrap": """
SELECT a.id, coalesce(f.id, e.id, d.id, c.id, b.id, a.id) AS inner_id FROM log a LEFT JOIN log b ON a.id + 1 = b.id AND b.type <> 'PASS' LEFT JOIN log c ON b.id + 1 = c.id AND c.type <> 'PASS'
LEFT JOIN log d ON c.id + 1 = d.id AND d.type <> 'PASS' LEFT JOIN log e ON d.id + 1 = e.id AND e.type <> 'PASS' LEFT JOIN log f ON e.id + 1 = f.id AND f.type <> 'PASS'""",
}


def _varied(d) -> dict[str, str]:
    """Queries that spell something differently in either dialect."""
    s = d is Spark
    distinct_list = "array_join(array_sort(collect_set(label)), ',')" if s else "array_to_string(list_sort(list(DISTINCT label)), ',')"
    ordered = "array_join(transform(array_sort(collect_list(struct(id, k, word))), x -> x.word), '')" if s else "string_agg(word, '' ORDER BY id, k)"
    last = "max_by(prompt_tokens, CASE WHEN prompt_tokens > 0 THEN id END)" if s else "arg_max(prompt_tokens, CASE WHEN prompt_tokens > 0 THEN id END)"
    five = "array_join(slice(array_distinct(transform(array_sort(collect_list(struct(id, k, word))), x -> x.word)), 1, 5), ',')" if s else "array_to_string(list_slice(list(word ORDER BY f), 1, 5), ',')"
    js = d.js
    run = "sum(bytes) OVER (PARTITION BY day ORDER BY last_id DESC, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    newer = "coalesce(sum(b) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return {
        "agg13_usage_last": f"SELECT sid, {last} AS prompt FROM log GROUP BY sid",
        "agg14_samples": f"SELECT sid, count(*) AS total, {five} AS samples FROM items GROUP BY sid" if s else f"SELECT sid, sum(c)::BIGINT AS total, {five} AS samples FROM (SELECT sid, word, count(*) AS c, min(id * 10 + k) AS f FROM items GROUP BY sid, word) GROUP BY sid",
        "agg15_label_union": f"SELECT sid, {distinct_list} AS labels FROM items GROUP BY sid",
        "agg19_trace_bytes": f"SELECT sid, CAST(sum({d.bytes('payload')}) AS BIGINT) AS bytes FROM log GROUP BY sid",
        "win08_fragments": f"SELECT sid, label, {ordered} AS text FROM items GROUP BY sid, label",
        "win04_byte_budget": f"""
WITH s AS (SELECT sid, max(id) AS last_id, max(day) AS day, CAST(sum({d.bytes('payload')}) AS BIGINT) AS bytes FROM log GROUP BY sid),
  t AS (SELECT day, {newer} AS newer FROM (SELECT day, sum(bytes) AS b FROM s GROUP BY day) q)
SELECT sid, last_id FROM (SELECT s.sid, s.last_id, t.newer + {run.replace('day ORDER', 's.day ORDER')} AS total FROM s JOIN t ON s.day = t.day) q WHERE total <= 200000""",
        "prj01_summary": f"SELECT id, coalesce({js('payload', 'model')}, {js('payload', 'type')}, '') AS model, {js('payload', 'type')} AS type, {d.num(js('payload', 'n'))} AS n FROM log",
        "prj02_page": f"SELECT id, payload FROM log WHERE {js('payload', 'type')} = 'error' ORDER BY id LIMIT 50",
        "prj06_model": f"SELECT id, coalesce({js('payload', 'model')}, '') AS model FROM log",
        "str01_digest": f"SELECT DISTINCT word, substr({d.sha('word')}, 1, 16) AS digest FROM items",
        "str04_safe_label": f"SELECT DISTINCT kind, coalesce(nullif(substr({d.sub('upper(kind)', '[^A-Z0-9]', '')}, 1, 12), ''), 'TERM') AS label FROM log",
    }


def text_queries(d) -> dict[str, str]:
    """Signals over document and conversation texts."""
    lines = "size(split(text, '\\n'))" if d is Spark else "len(string_split(text, chr(10)))"
    return {
        "src05_lines": f"SELECT doc_id, CAST({lines} AS BIGINT) AS n_lines FROM documents",
        "src06_content_type": "SELECT page_id, CASE WHEN lower(ct) LIKE '%event-stream%' THEN 'sse' WHEN lower(ct) LIKE '%ndjson%' THEN 'ndjson' WHEN lower(ct) LIKE '%json%' THEN 'json' ELSE 'other' END AS framing FROM (SELECT page_id, CASE length(html) % 4 WHEN 0 THEN 'text/Event-Stream' WHEN 1 THEN 'application/x-ndjson' WHEN 2 THEN 'application/json; charset=utf-8' ELSE 'text/html' END AS ct FROM pages) q",
        "src11_encodings": "SELECT page_id, lower(trim(e)) AS enc, lower(trim(e)) IN ('', 'identity') AS plain, lower(trim(e)) IN ('gzip', 'x-gzip', 'deflate', 'br', 'zstd') AS decodable FROM (SELECT page_id, CASE length(html) % 3 WHEN 0 THEN ' GZip ' WHEN 1 THEN 'identity' ELSE 'zip' END AS e FROM pages) q",
        "prj10_first_user": "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') q WHERE r = 1",
        "agg22_placeholders": f"SELECT doc_id, {d.count('t', r'\{\{[A-Z0-9]+_[a-z]{6}\}\}')} AS n FROM (SELECT doc_id, replace(text, ' the ', ' {{{{TERM_bcdfgh}}}} ') AS t FROM documents) q".replace("{{{{", "{{").replace("}}}}", "}}"),
    }


def all_sql(d) -> dict[str, str]:
    return PLAIN | _varied(d) | text_queries(d)


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query over ``sf_dir`` alone: tables are named by their paths within the statement, and no view of the session's is touched."""
    body = all_sql(Spark)[name].strip()
    read = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES]
    head = ", ".join([*read, f"log AS ({log(Spark)})", f"items AS ({items(Spark)})"])
    return spark.sql(f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}")


def _oracle(sql: str) -> str:
    body = sql.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN").strip()
    head = f"log AS ({log(Duck)}), items AS ({items(Duck)})"
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(_run, name) for name in all_sql(Spark)}
ORACLES = {name: _oracle(sql) for name, sql in all_sql(Duck).items()}
