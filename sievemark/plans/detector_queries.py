"""One query for each detector over the corpus, and masking and restoring over all of it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import CREDENTIALS, RULES, Rule, conditions
from ..functions.dialect import Duck
from ..functions.masking import CONSONANTS, PLACEHOLDER, Settings, safe_label
from ..operators import detect, masking
from ..sources.corpus import corpus, corpus_sql

KEY = "test-key"


def candidates_sql(rule: Rule, source: str) -> str:
    p = Duck.lit(rule.pattern)
    value = f"regexp_extract(whole, {p}, {rule.group})" if rule.group else "whole"
    return f"""
SELECT row_id, src, i::BIGINT AS ord, whole, {value} AS value, lft, rgt FROM (
  SELECT row_id, src, i, vals[i + 1] AS whole, coalesce(vals[i], '') || gaps[i + 1] AS lft, gaps[i + 2] || coalesce(vals[i + 2], '') AS rgt
  FROM (SELECT row_id, src, vals, gaps, unnest(range(len(vals))) AS i
        FROM (SELECT row_id, src, regexp_extract_all(text, {p}, 0) AS vals, regexp_split_to_array(text, {p}) AS gaps FROM ({source}) WHERE regexp_matches(text, {p}))))
"""


def find_sql(rule: Rule, source: str | None = None) -> str:
    return f"SELECT row_id, src, ord, '{rule.label}' AS label, value FROM ({candidates_sql(rule, source or corpus_sql())}) WHERE {conditions(rule, Duck)}"


def token_sql(label: str, value: str) -> str:
    digest = f"sha256('{KEY}|0|' || {value})"
    letters = " || ".join(f"substr('{CONSONANTS}', (('0x' || substr({digest}, {2 * i + 1}, 2))::INT % 19 + 1)::INT, 1)" for i in range(6))
    return f"('{{{{{safe_label(label)}_' || {letters} || '}}}}')"


def mask_sql(rule: Rule, source: str) -> str:
    """One rule's stage: its values replaced within their candidates, unless a placeholder is touched."""
    p = Duck.lit(rule.pattern)
    token = token_sql(rule.label, "value")
    before = f"left(whole, length(whole) - length(value) - {rule.after})"
    shown = f"({before} || {token} || right(whole, {rule.after}))" if rule.after else f"({before} || {token})" if rule.group else token
    free = f"NOT regexp_matches(whole, {Duck.lit(PLACEHOLDER)})"
    return f"""
SELECT c.row_id, c.src, CASE WHEN p.row_id IS NULL THEN c.text ELSE list_aggregate(list_transform(regexp_split_to_array(c.text, {p}), lambda g, i: g || coalesce(p.p[i], '')), 'string_agg', '') END AS text,
       coalesce(p.n, 0)::BIGINT AS n_masked
FROM ({source}) c LEFT JOIN (
  SELECT row_id, list(s ORDER BY ord) AS p, sum(keep::INT) AS n FROM (
    SELECT row_id, ord, keep, CASE WHEN keep THEN {shown} ELSE whole END AS s FROM (SELECT *, ({conditions(rule, Duck)} AND {free}) AS keep FROM ({candidates_sql(rule, source)})))
  GROUP BY row_id) p ON c.row_id = p.row_id
"""


def _find(rule: Rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.find(corpus(spark, sf_dir), rule)


def _mask(rule: Rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that one rule changes."""
    masked = masking.mask(corpus(spark, sf_dir), Settings(rules=frozenset([rule.key])), KEY)
    return masked.where(F.size("hits") > 0).select("row_id", "src", "text", F.regexp_count("text", F.lit(PLACEHOLDER)).cast("long").alias("n_tokens"))


def all_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by label and source of all rules that are on by default."""
    return detect.find_all(corpus(spark, sf_dir)).groupBy("label", "src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


MASKED = [r for r in RULES if r.key in ("det17_connection_string", "det18_mobile", "det19_email", "det31_card", "det24_idcard_18")]
#: The rules of default masking, in order.
DEFAULT = [r for r in RULES if r.on]


def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking by all rules that are on, in order, each on the text that the ones before it left."""
    masked = masking.mask(corpus(spark, sf_dir), Settings(), KEY)
    return masked.where(F.size("hits") > 0).select("row_id", "src", F.sha2("text", 256).alias("digest"), F.regexp_count("text", F.lit(PLACEHOLDER)).cast("long").alias("n_tokens"))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts masked by all rules that are on, then restored from the mapping: as they were."""
    back = masking.round_trip(corpus(spark, sf_dir), Settings(), KEY, changed=True)
    return back.select("row_id", (F.col("restored") > 0).alias("restored"), F.sha2("restored_text", 256).alias("digest"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, value and token of every mobile number and e-mail address."""
    rules = [r for r in RULES if r.key in ("det18_mobile", "det19_email")]
    return masking.tokens(detect.find_all(corpus(spark, sf_dir), rules), KEY).select("label", "value", "token")


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs without credentials: texts that redaction changes."""
    df = corpus(spark, sf_dir).withColumn("clean", detect.redact(F.col("text")))
    return df.where("clean <> text").select("row_id", "clean")


def _redacted_sql() -> str:
    text = "text"
    for r in RULES[1:]:
        if r.label in CREDENTIALS:
            text = f"regexp_replace({text}, {Duck.lit(r.pattern)}, '[REDACTED]', 'g')"
    # the prefix rule with its checks, as a stage of its own over candidates and gaps
    rule, p = RULES[0], Duck.lit(RULES[0].pattern)
    source = f"SELECT row_id, '' AS src, {text} AS text FROM ({corpus_sql()})"
    pieces = f"SELECT row_id, list(CASE WHEN {conditions(rule, Duck)} THEN '[REDACTED]' ELSE whole END ORDER BY ord) AS p FROM ({candidates_sql(rule, 'SELECT * FROM red')}) GROUP BY row_id"
    woven = f"CASE WHEN p.row_id IS NULL THEN red.text ELSE list_aggregate(list_transform(regexp_split_to_array(red.text, {p}), lambda g, i: g || coalesce(p.p[i], '')), 'string_agg', '') END"
    return f"WITH red AS MATERIALIZED ({source}), p AS ({pieces}), c AS ({corpus_sql()}) SELECT c.row_id, {woven} AS clean FROM red JOIN c ON c.row_id = red.row_id LEFT JOIN p ON p.row_id = red.row_id WHERE c.text <> {woven}"


def _all_rules_sql() -> str:
    source = corpus_sql()
    ctes = [f"s0 AS MATERIALIZED ({source})"]
    for i, rule in enumerate(DEFAULT):
        ctes.append(f"s{i + 1} AS MATERIALIZED (SELECT row_id, src, text FROM ({mask_sql(rule, f'SELECT * FROM s{i}')}))")
    p, last = Duck.lit(PLACEHOLDER), len(DEFAULT)
    return f"WITH {', '.join(ctes)} SELECT a.row_id, a.src, sha256(a.text) AS digest, len(regexp_extract_all(a.text, {p}))::BIGINT AS n_tokens FROM s{last} a JOIN s0 b ON a.row_id = b.row_id WHERE a.text <> b.text"


_MOBILE = next(r for r in RULES if r.key == "det18_mobile")
_EMAIL = next(r for r in RULES if r.key == "det19_email")

QUERIES = {r.key: partial(_find, r) for r in RULES} | {f"msk_{r.key[6:]}": partial(_mask, r) for r in MASKED}
QUERIES |= {"det37_all_default": all_default, "msk01_all_rules": all_rules, "rst01_round_trip": round_trip, "msk04_mapping": mapping, "det38_redacted": redacted}
ORACLES = {r.key: find_sql(r) for r in RULES}
ORACLES |= {
    f"msk_{r.key[6:]}": f"SELECT row_id, src, text, len(regexp_extract_all(text, {Duck.lit(PLACEHOLDER)}))::BIGINT AS n_tokens FROM ({mask_sql(r, corpus_sql())}) WHERE n_masked > 0" for r in MASKED
}
ORACLES |= {
    "det37_all_default": "SELECT label, src, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS n_values FROM ("
    + " UNION ALL ".join(f"({find_sql(r)})" for r in RULES if r.on)
    + ") GROUP BY label, src",
    "msk01_all_rules": _all_rules_sql(),
    "rst01_round_trip": f"SELECT c.row_id, TRUE AS restored, sha256(c.text) AS digest FROM ({corpus_sql()}) c JOIN ({_all_rules_sql()}) m ON c.row_id = m.row_id",
    "msk04_mapping": f"SELECT DISTINCT label, value, {token_sql('PHONE', 'value')} AS token FROM ({find_sql(_MOBILE)}) UNION SELECT DISTINCT label, value, {token_sql('EMAIL', 'value')} AS token FROM ({find_sql(_EMAIL)})",
    "det38_redacted": _redacted_sql(),
}
