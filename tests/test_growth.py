"""Work on each row that grows with the table: done once, within the row, by all tasks, and only where it can find anything."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemark.functions import texts as T
from sievemark.functions.detectors import RULES
from sievemark.operators import commands, detect, requests, signals
from sievemark.plans import signal_queries
from sievemark.sources.corpus import corpus

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_functions_escape_once(spark):
    assert " AS esc#" in _plan(signal_queries.text_functions(spark, SF))


@pytest.mark.parametrize("text", ["", "a", "abc", "aab\n\n\"é漢字漢", "x" * 50 + "😀" * 3])
def test_entropy_and_escapes(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(T.entropy(F.col("t")).alias("e"), T.json_escaped(F.col("t")).alias("j"), T.first_difference(F.col("t"), F.lit("abd")).alias("d"), T.truncated(F.col("t"), 7).alias("s")).first()
    want = -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())
    assert row.e == pytest.approx(want, abs=1e-12)
    assert row.j == text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    assert row.d == next((i for i in range(max(len(text), 3)) if text[i : i + 1] != "abd"[i : i + 1]), -1)
    assert row.s == text.encode()[:7].decode(errors="ignore")


def test_redaction_looks_for_marks_first(spark):
    """A rule's pattern runs only where one of its words is, in any case."""
    plan = _plan(spark.createDataFrame([("x",)], "t string").select(detect.redact(F.col("t"))))
    assert plan.count("CASE WHEN") == plan.count("regexp_replace(") > 9
    texts = ["AWS_Secret_Access_KEY: " + "a1" * 20, "BEARER " + "a1" * 12, "PassWord=abc12345", "密码：abc12345", "nothing"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(detect.redact(F.col("t")).alias("c")).collect()]
    assert ["[REDACTED]" in c for c in got] == [True] * 4 + [False]


def test_rules_have_their_words():
    """Every word in a rule's list of shapes is one without which it can't hit."""
    for key, text in (("det13_aws_secret", "AwsSecretAccessKey=" + "a" * 40), ("det15_bearer", "bEarer " + "a" * 20), *(("det16_secret_pair", f"{w}=abcdef1") for w in "passwd PWD Secret TOKEN api_key accesskey Private-Key 口令 令牌 秘钥 密匙 凭据 凭证 私钥 授权码 访问密钥 接口密钥".split())):
        rule = next(r for r in RULES if r.key == key)
        assert re.search(rule.pattern, text) and any(w in text.lower() for w in rule.words)


def test_headers_are_logged_within_their_row(spark):
    h = [("Accept", "*"), ("Cookie", "abc"), *((f"X-{i}", "é" * 2000) for i in range(9)), *((f"n{i}", "") for i in range(200))]
    rows = spark.createDataFrame([(1, h), (2, [("A", None)]), (3, []), (4, None)], "row_id int, headers array<struct<name:string,value:string>>")
    got = requests.logged_headers(rows)
    assert "Window" not in _plan(got) and "Aggregate" not in _plan(got)
    found = {r.row_id: [(x["name"], x["value"]) for x in r.headers] for r in got.collect()}
    long_ = "é" * 1024 + "…"
    # 7 of 2,054 bytes and the two before them are within 16 KiB
    assert found == {1: [("accept", "*"), ("cookie", "***"), *((f"x-{i}", long_) for i in range(7)), ("x-shield-truncated", "true")], 2: [("a", None)]}


def test_customers_are_dealt_out(spark):
    cust = corpus(spark, SF).where("src = 'cust'").select(F.spark_partition_id().alias("p"))
    assert cust.distinct().count() > 1


def test_texts_are_scanned_once_for_new_values(spark):
    assert "parquet" not in signal_queries.new_values(spark, SF)._jdf.queryExecution().executedPlan().toString().lower()


def test_bodies_without_commands_are_not_parsed(spark):
    rows = spark.createDataFrame([("a", '{"arguments":"hello"}'), ("b", '{"arguments":"\\u0072m -rf /"}'), ("c", '{"arguments":"dd if=x of=\\/dev\\/sda"}')], "row_id string, body string")
    got = commands.body_hits(rows)
    assert "Filter" in _plan(got).split("MapInArrow")[-1] and {r.row_id for r in got.collect()} == {"b", "c"}


def test_signals_are_worked_out_where_they_can_be(spark):
    rows = spark.createDataFrame([("a", "Tel 138 c1@mail.example.com", None)], "row_id string, text string, request string")
    staged = signals._staged(rows)
    assert len(signals._poison_parts()) == 1 and staged.select(F.size(signals._poison_parts()[0])).first()[0] == 0


def test_spans_take_little_memory(spark):
    """A span is two numbers and a kind until it leaves the worker, and finding takes time in proportion to the text."""
    rows = spark.createDataFrame([("the them {{PHONE_bcdfgh}} e",), (None,), ("",), ("é" + "e" * 200_000,)], "t string")
    got = [r.s for r in rows.coalesce(1).select(T.marked(F.col("t"), F.array(F.lit("the"), F.lit("them"), F.lit("e"), F.lit(""))).alias("s")).collect()]
    assert [(x.start, x.end, x.kind) for x in got[0]] == [(0, 3, "value"), (4, 8, "value"), (9, 25, "placeholder"), (26, 27, "value")]
    assert got[1] is None and got[2] == [] and len(got[3]) == 200_000
