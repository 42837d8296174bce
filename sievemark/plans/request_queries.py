"""Queries of requests: admission, headers, events, traces, export, dictionary and user patterns, embedded files. Their SQL is written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.detectors import RULES
from ..functions.masking import Settings
from ..operators import bodies as B
from ..operators import masking, requests
from ..operators.tables import spread
from ..sources.corpus import corpus, corpus_sql
from .detector_queries import KEY, _redacted_sql, find_sql, token_sql
from .json_queries import bodies




def _every(n: int):
    return F.col("id") % n == 0


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of each page as a request: routed by its host, its body the page as JSON, cut off or too large by its length, which decides the rest as well."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("id", F.length("html"))
    body = F.concat(F.lit('{"html":'), F.regexp_extract(F.to_json(F.struct(F.col("html").alias("h"))), r'(?s)\A\{"h":(.*)\}\z', 1), F.when(_every(5), "").otherwise("}"))
    made = pages.select(
        "page_id", (~F.col("url").contains(".org/")).alias("routed"), F.when(_every(11), "get").otherwise("POST").alias("method"), _every(13).alias("paused"), F.when(_every(17), " GZip ").when(_every(19), "zip").otherwise("identity").alias("encoding"),
        _every(34).alias("decoded"), F.when(_every(7), "text/plain").otherwise("Application/JSON").alias("content_type"), body.alias("body"), (~_every(3)).alias("known"), _every(23).alias("failed"), _every(29).alias("blocked"),
    )
    seen = made.withColumn("valid", udfs.json_valid("body"))
    both = [requests.admitted(seen, closed, 12_000).select("page_id", F.lit(closed).alias("fail_closed"), "type", "status", "reason") for closed in (True, False)]
    return both[0].unionByName(both[1])


def _admission_sql() -> str:
    shut = lambda status, reason: f"CASE WHEN closed THEN ['BLOCK', '{status}', '{reason}'] ELSE ['BYPASS', '200', '{reason}'] END"
    verdict = f"""CASE WHEN contains(url, '.org/') THEN ['BLOCK', '502', 'no_reverse_route'] WHEN strlen(body) > 12000 THEN ['BLOCK', '413', 'too_large'] WHEN id % 11 = 0 THEN ['PASS', '200', 'readonly_method'] WHEN id % 13 = 0 THEN ['BYPASS', '200', 'filter_disabled']
 WHEN id % 17 = 0 AND id % 34 <> 0 THEN ['BLOCK', '415', 'unsupported_encoding'] WHEN id % 17 <> 0 AND id % 19 = 0 THEN ['BLOCK', '415', 'unsupported_encoding'] WHEN id % 7 = 0 THEN {shut(503, 'non_json')} WHEN NOT json_valid(body) THEN {shut(400, 'invalid_json')}
 WHEN id % 3 = 0 AND NOT closed THEN ['BYPASS', '200', 'unknown_shape'] WHEN id % 23 = 0 THEN ['BLOCK', '503', 'pipeline'] WHEN id % 29 = 0 THEN ['BLOCK', '503', 'rule_block'] ELSE ['MASK', '200', ''] END"""
    body = """'{"html":' || to_json(html)::VARCHAR || CASE WHEN length(html) % 5 = 0 THEN '' ELSE '}' END"""
    return f"SELECT page_id, closed AS fail_closed, v[1] AS type, v[2]::INT AS status, v[3] AS reason FROM (SELECT page_id, closed, {verdict} AS v FROM (SELECT page_id, url, length(html) AS id, closed, {body} AS body FROM pages, (VALUES (TRUE), (FALSE)) c(closed)))"


def byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bodies under a cap of 10,000 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs.select("doc_id", F.col("text").alias("body"), F.lit(True).alias("routed"), F.lit("POST").alias("method"), F.lit(False).alias("paused"), F.lit("").alias("encoding"), F.lit(True).alias("decoded"), F.lit("application/json").alias("content_type"), F.lit(True).alias("valid"), F.lit(True).alias("known"), F.lit(False).alias("failed"), F.lit(False).alias("blocked"))
    return requests.admitted(seen, True, 10_000).select("doc_id", "status")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of each customer's request for the log: credentials as stars, long values and long lists cut."""
    rows = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), "c_custkey")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    many = F.transform(F.sequence(F.lit(1), F.lit(3) + (F.col("c_custkey") % 12).cast("int")), lambda i: F.struct(F.concat(F.lit("X-"), i.cast("string")).alias("name"), F.repeat(F.lit("v"), 500 * i).alias("value")))
    listed = F.concat(F.array(pair("Authorization", F.col("c_name")), pair("Accept", F.lit("*/*")), pair("Connection", F.lit("close"))), many)
    made = rows.select("c_custkey", requests.forwarded(listed).alias("headers"))
    got = requests.logged_headers(made, key="c_custkey")
    return got.select("c_custkey", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), F.length(h["value"]).cast("string"))), ",").alias("shown"), F.get("headers", F.lit(0))["value"].alias("first"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with words of a dictionary masked, the longest first, in any case."""
    settings = Settings(rules=frozenset(), words=WORDS)
    masked = masking.mask(corpus(spark, sf_dir), settings, KEY)
    return masked.where(F.size("hits") > 0).select("row_id", F.sha2("text", 256).alias("digest"))


#: Words of the dictionary, all lower case and without word boundaries of their own.
WORDS = (("mail", "TERM"), ("user", "NAME"), ("username", "NAME"), ("example", "ORG"), ("password", "TERM"))


def _dictionary_sql() -> str:
    longest = sorted(WORDS, key=lambda w: (-len(w[0]), w[0]))
    pattern = "(?i)" + "|".join(w for w, _ in longest)
    token = "CASE lower(v) " + " ".join(f"WHEN '{w}' THEN {token_sql(n, f"'{w}'")}" for w, n in longest) + " END"
    woven = f"list_aggregate(list_transform(regexp_split_to_array(text, '{pattern}'), lambda g, i: g || coalesce(list_transform(regexp_extract_all(text, '{pattern}'), lambda v: {token})[i], '')), 'string_agg', '')"
    return f"SELECT row_id, sha256({woven}) AS digest FROM ({corpus_sql()}) WHERE regexp_matches(text, '{pattern}') AND text NOT LIKE '%{{{{%'"


PATTERN = "c[0-9]+@mail[0-9]+"


def user_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a user's pattern masked."""
    masked = masking.mask(corpus(spark, sf_dir), Settings(rules=frozenset(), patterns=(("cust", PATTERN),)), KEY)
    return masked.where(F.size("hits") > 0).select("row_id", F.sha2("text", 256).alias("digest"))


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of masking where mobile numbers are warned of, cards block, and one address is allowed."""
    settings = Settings(rules=frozenset(["det18_mobile", "det31_card", "det19_email"]), actions=(("PHONE", "warn"), ("CARD", "block")), allow=frozenset(["c1@mail15.example.com", "ann.lee@corp.cn"]))
    masked = masking.mask(corpus(spark, sf_dir), settings, KEY)
    label = lambda n: F.size(F.filter("hits", lambda h: h["label"] == n)).cast("long")
    return masked.where("warned > 0 OR size(hits) > 0").select("row_id", "warned", label("EMAIL").alias("n_email"), label("PHONE").alias("n_phone"), (F.size("blocked_labels") > 0).alias("blocked"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded files of bodies: those of every third turn hold one."""
    turn = F.split_part("row_id", F.lit(":"), F.lit(2)).cast("int")
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode(F.repeat(F.lit("x"), turn + 10), "utf-8")))
    made = bodies(spark, sf_dir).withColumn("body", F.to_json(F.struct(F.when(turn % 3 == 0, uri).otherwise(F.lit("none")).alias("image"), F.col("body").alias("text"))))
    return B.described(made).select("row_id", "n_blobs", "blob_bytes")


def restore_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of responses: those that masked texts give when restored from a mapping that misses every value of odd length; one without a text of its own is blocked."""
    settings = Settings(rules=frozenset(["det18_mobile", "det19_email"]))
    source = corpus(spark, sf_dir)
    masked, mapping = masking.mask_apart(source, settings, KEY)
    back = masking.restore(masked, mapping.where(F.length("value") % 2 == 0))
    made = back.select(F.col("row_id").alias("sid"), F.coalesce(F.length("text") < 3, F.lit(True)).alias("blocked"), "restored", "unresolved", "samples", F.length("text").alias("first_byte_ms"), F.lit(0).alias("upstream_ms"))
    return requests.restore_events(made.where("sid NOT LIKE 'case:%'")).select("sid", "restore_status", "restored", "unresolved", F.col("first_byte_ms").isNull().alias("no_time"))


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = docs.select(F.col("doc_id").alias("sid"), F.lit("req").alias("kind"), F.col("text").alias("primary_body"), F.reverse("text").alias("secondary_body"))
    got = requests.traces(made, each_bytes=500)
    return got.select("sid", F.sha2("primary_body", 256).alias("primary_digest"), "primary_bytes", "truncated")


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest documents for export: redacted, within a row and byte limit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" sk-abcdefghijklmnopqrstuvwxyz123456")).alias("payload"))
    return requests.exported(docs, rows=100, most_bytes=200_000).select("id", F.sha2("payload", 256).alias("digest"), "truncated")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return conv.select("conv_id", "turn", F.substring(requests.session_id(F.lit("10.0.0.1"), F.concat(F.lit('"'), F.col("conv_id").cast("string"), F.lit('"')), F.lit("n")), 1, 18).alias("session"))


QUERIES = {
    "flt17_admission": admission, "src01_byte_cap": byte_cap, "prj11_headers": headers, "det35_dictionary": dictionary, "det36_custom_regex": user_pattern, "msk03_policy": policy, "flt18_blobs": embedded,
    "evt02_restore_events": restore_log, "trc01_capture_gate": trace_log, "snk05_export": export, "str17_session_id": sessions,
}
_CUT = "CASE WHEN strlen({0}) <= 500 THEN {0} ELSE left({0}, list_max(list_filter(range(0, 501), lambda k: strlen(left({0}, k)) <= 500))::INT) END"
ORACLES = {
    "flt17_admission": _admission_sql(),
    "src01_byte_cap": "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > 10000 THEN 413 ELSE 200 END AS status FROM documents",
    "prj11_headers": """
WITH h AS (SELECT c_custkey, 0 AS pos, 'authorization' AS name, '***' AS value FROM customer UNION ALL SELECT c_custkey, 1, 'accept', '*/*' FROM customer
  UNION ALL SELECT c_custkey, i + 1, 'x-' || i, CASE WHEN 500 * i > 2048 THEN repeat('v', 2048) || '…' ELSE repeat('v', 500 * i) END FROM (SELECT c_custkey, unnest(range(1, 4 + c_custkey % 12)) AS i FROM customer)),
  s AS (SELECT *, sum(strlen(name) + strlen(value)) OVER (PARTITION BY c_custkey ORDER BY pos) <= 16384 AS fits FROM h)
SELECT c_custkey, string_agg(name || '=' || length(value), ',' ORDER BY pos) FILTER (fits) || CASE WHEN count(*) FILTER (NOT fits) > 0 THEN ',x-shield-truncated=4' ELSE '' END AS shown, '***' AS first FROM s GROUP BY c_custkey""",
    "det35_dictionary": _dictionary_sql(),
    "det36_custom_regex": f"SELECT row_id, sha256(list_aggregate(list_transform(regexp_split_to_array(text, '{PATTERN}'), lambda g, i: g || coalesce(list_transform(regexp_extract_all(text, '{PATTERN}'), lambda v: {token_sql('cust', 'v')})[i], '')), 'string_agg', '')) AS digest FROM ({corpus_sql()}) WHERE regexp_matches(text, '{PATTERN}')",
    "msk03_policy": "WITH f AS (" + " UNION ALL ".join(f"({find_sql(r)})" for r in RULES if r.key in ("det18_mobile", "det31_card", "det19_email")) + ") SELECT * FROM (SELECT row_id, count(*) FILTER (label = 'PHONE') AS warned, count(DISTINCT value) FILTER (label = 'EMAIL' AND lower(value) NOT IN ('c1@mail15.example.com', 'ann.lee@corp.cn')) AS n_email, CAST(0 AS BIGINT) AS n_phone, count(*) FILTER (label = 'CARD') > 0 AS blocked FROM f GROUP BY row_id) WHERE warned > 0 OR n_email > 0 OR blocked",
    "flt18_blobs": "SELECT conv_id || ':' || turn AS row_id, (turn % 3 = 0)::BIGINT AS n_blobs, CASE WHEN turn % 3 = 0 THEN 22 + 4 * ((turn + 12) // 3) ELSE 0 END::BIGINT AS blob_bytes FROM conversations",
    "evt02_restore_events": f"""
WITH f AS (SELECT row_id, count(*) FILTER (length(value) % 2 = 0) AS good, count(*) FILTER (length(value) % 2 = 1) AS bad FROM ({' UNION ALL '.join(f'({find_sql(r)})' for r in RULES if r.key in ('det18_mobile', 'det19_email'))}) GROUP BY row_id)
SELECT c.row_id AS sid, CASE WHEN coalesce(length(text), 0) < 3 THEN 'blocked' WHEN bad > 0 THEN 'unresolved' WHEN good > 0 THEN 'restored' ELSE 'no_sensitive_data' END AS restore_status, coalesce(good, 0) AS restored, coalesce(bad, 0) AS unresolved, coalesce(length(text), 0) = 0 AS no_time
FROM ({corpus_sql()}) c LEFT JOIN f ON c.row_id = f.row_id WHERE c.row_id NOT LIKE 'case:%'""",
    "trc01_capture_gate": f"SELECT doc_id AS sid, sha256({_CUT.format('text')}) AS primary_digest, coalesce(strlen(text), 0)::BIGINT AS primary_bytes, coalesce(strlen(text), 0) > 500 AS truncated FROM documents",
    "snk05_export": f"""
WITH c AS ({_redacted_sql()}), n AS (SELECT doc_id AS id, coalesce(clean, text) || ' [REDACTED]' AS payload FROM documents LEFT JOIN c ON row_id = 'doc:' || doc_id WHERE text IS NOT NULL ORDER BY doc_id DESC LIMIT 101),
s AS (SELECT *, row_number() OVER (ORDER BY id DESC) <= 100 AND sum(strlen(payload) + 1) OVER (ORDER BY id DESC) <= 200000 AS fits FROM n)
SELECT id, sha256(payload) AS digest, (SELECT count(*) FROM s WHERE NOT fits) > 0 AS truncated FROM s WHERE fits""",
    "str17_session_id": "SELECT conv_id, turn, left(sha256('10.0.0.1' || chr(34) || conv_id || chr(34)), 16) || '-n' AS session FROM conversations WHERE role = 'user'",
}
