"""Results don't depend on how large tables are: whatever is broadcast or joined, whole texts are used."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sievemark.functions import masking as M
from sievemark.operators import commands, containment, masking, responses
from sievemark.plans import flow_queries, signal_queries, stream_queries
from sievemark.streaming import restore

SF = "/root/testdata/sf0.001"
TOKEN = M.token_of("k", "PHONE", "13812345678")


def _stream(pieces: list[str]) -> str:
    return "".join(f"data: {json.dumps({'choices': [{'index': 0, 'delta': {'content': p}}]})}\n\n" for p in pieces) + "data: [DONE]\n\n"


@pytest.mark.parametrize("most", [0, 250_000])
def test_placeholders_cut_by_events_are_restored_whatever_the_mappings_size(spark, monkeypatch, most):
    monkeypatch.setattr(masking, "BROADCAST_ROWS", most)
    text = f"call {TOKEN} now"
    bodies = [("cut", "text/event-stream", _stream([text[i : i + 3] for i in range(0, len(text), 3)])), ("lines", "application/x-ndjson", json.dumps({"message": {"content": text}, "done": True})), ("plain", "text/plain", text), ("escaped", "application/json", json.dumps({"a": text}).replace("_", "\\u005f")), ("none", "text/plain", None)]
    mapping = spark.createDataFrame([(TOKEN, "13812345678"), (M.token_of("k", "PHONE", "1"), "1")], "token string, value string")
    got = {r.row_id: r for r in responses.restore_bodies(spark.createDataFrame(bodies, "row_id string, content_type string, text string"), mapping).collect()}
    assert {k: (r.restored, r.unresolved) for k, r in got.items()} == {k: (int(k != "none"), 0) for k, *_ in bodies}
    held = "".join(json.loads(x[6:])["choices"][0]["delta"]["content"] for x in got["cut"].text.split("\n\n") if x.startswith("data: {"))
    assert held == "call 13812345678 now"
    rows = masking.restore_bodies(spark.createDataFrame([b[::2] for b in bodies if b[0] in ("escaped", "plain")], "row_id string, text string"), mapping).collect()
    assert [r.restored for r in rows] == [1, 1]


def test_whole_responses_of_any_number_of_values(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, stream_queries.whole_responses(spark, SF).collect()))
    want = rows()
    monkeypatch.setattr(masking, "BROADCAST_ROWS", 0)
    assert rows() == want and want and all(r[3] > 0 and r[4] == 0 for r in want)


def test_commands_are_found_anywhere_in_long_texts(spark):
    text = "é" * 400_000 + " rm -rf / " + "é" * 400_000
    body = json.dumps({"input": {"arguments": json.dumps({"cmd": text}, ensure_ascii=False)}}, ensure_ascii=False)
    hits = commands.body_hits(spark.createDataFrame([("b", body)], "row_id string, body string")).collect()
    assert [(r.kind, r.id) for r in hits] == [("tool", "builtin-rm-root")]
    rows = spark.createDataFrame([("s", "c0.tool0", text)], "sid string, channel string, text string")
    assert commands.judged(rows, allow=("-rf",)).first().hit is None and commands.without_echoes(commands.judged(rows), rows).count() == 0
    two = spark.createDataFrame([("drop table a; DROP table b",)], "t string").select(commands.first_hit(F.col("t"), allow=("drop",)).alias("h")).first().h
    assert two.snippet == "DROP table"


def test_values_are_found_beyond_the_first_512_kib(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "doc", "é" * 300_000 + " call 13812345678 now")], "row_id string, src string, text string")
    monkeypatch.setattr(signal_queries, "corpus", lambda *_: rows)
    assert [tuple(r) for r in signal_queries.new_values(spark, SF).collect()] == [("a", "PHONE", "13812345678")]
    assert [tuple(r) for r in flow_queries.scan_events(spark, SF).collect()] == [("a", "SCANWARN", 1, "PHONE")]


def test_chunks_of_a_stream_are_cut_from_bytes_once_and_carry_known_tokens_as_text(spark):
    rows = spark.createDataFrame([("s", 0, "sse", b"x", True)], "sid string, seq long, framing string, chunk binary, final boolean")
    known = spark.createDataFrame([("s", {TOKEN: "1"})], "sid string, known map<string,string>")
    assert dict(restore._with_known(rows, known).dtypes)["known"] == "string"


def test_chunks_that_wait_in_the_state_come_in_order(spark, tmp_path):
    data = _stream(["é" + TOKEN[:6], TOKEN[6:]]).replace("\\u00e9", "é").encode()
    cut = [data[i : i + 7] for i in range(0, len(data), 7)]
    rows = [("s", i, "sse", c, i == len(cut) - 1) for i, c in enumerate(cut)]
    schema = "sid string, seq long, framing string, chunk binary, final boolean"
    for n, part in enumerate((rows[5:], rows[:5])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n{n}")
    known = spark.createDataFrame([("s", {TOKEN: "13812345678"})], "sid string, known map<string,string>")
    stream = restore.restore_frames(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), known, None)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").orderBy("seq").collect()
    text = "".join(r.text for r in got)
    assert sum(r.restored for r in got) == 1 and "13812345678" in text and "é" in text and TOKEN not in text


def test_more_values_than_suffixes_are_refused_at_once(spark, monkeypatch):
    monkeypatch.setattr(masking, "SUFFIXES", 3)
    values = spark.createDataFrame([("PHONE", str(i)) for i in range(4)] + [("EMAIL", "a")], "label string, value string")
    assert masking.tokens(values.where("value <> '3'"), "k").count() == 4
    with pytest.raises(ValueError, match="too many values"):
        masking.tokens(values, "k")


def test_only_texts_that_may_hold_a_mark_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(containment, "BROADCAST_BYTES", 0)
    texts = spark.createDataFrame([("a", "x needle y"), ("b", "nothing"), ("a", "x needle y"), (None, "needle")], "row_id string, text string")
    got = containment.occurrences(texts, spark.createDataFrame([("needle",), ("other words",)], "mark string"))
    assert [tuple(r) for r in got.collect()] == [("a", "needle")]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
