import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sievemark.functions import blobs, frames, json_spans, udfs
from sievemark.functions import masking as M
from sievemark.operators import bodies as B
from sievemark.operators import masking
from sievemark.plans import json_queries
from sievemark.streaming import restore

TOKENS = {"{{PHONE_bcdfgh}}": "13812345678", "{{EMAIL_zzzzzz}}": "a@b.cn"}
KNOWN = restore.by_suffix(TOKENS)


def test_any_split_restores_as_the_whole():
    text = "call {{PHONE_bcdfgh}} or {{EMAIL_zzzzzz}}, not {{CARD_bbbbbb}} {{ {x} {{PHONE_"
    whole, _ = restore.feed("", text, KNOWN, True)
    rng = random.Random(3)
    for _ in range(500):
        cuts = sorted(rng.sample(range(len(text) + 1), rng.randint(0, 8)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        held, out, n, missing = "", "", 0, 0
        for i, p in enumerate(parts):
            one, held = restore.feed(held, p, KNOWN, i == len(parts) - 1)
            out, n, missing = out + one.text, n + one.restored, missing + one.unresolved
        assert (out, n, missing) == (whole.text, whole.restored, whole.unresolved)


def sessions(spark, *sids):
    return spark.createDataFrame([(s, TOKENS) for s in sids], "sid string, known map<string, string>")


def test_stream_of_fragments_out_of_order(spark, tmp_path):
    text = "call {{PHONE_bcdfgh}} or {{EMAIL_zzzzzz}}!"
    rows = [("s1", "c", i, text[5 * i : 5 * i + 5], 5 * i + 5 >= len(text)) for i in range(-(-len(text) // 5))] + [("s2", "c", 0, "{{PHONE_", False), ("s2", "c", 1, "bcdfgh}}", True), ("s3", "c", 0, "{{PHONE_bcdfgh}}", True)]
    random.Random(1).shuffle(rows)
    schema = "sid string, channel string, seq long, text string, final boolean"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = restore.restore_stream(chunks, sessions(spark, "s1", "s2"), idle_ms=None).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("sid", "seq").collect()
    assert "".join(r.text for r in got if r.sid == "s1") == "call 13812345678 or a@b.cn!"
    assert "".join(r.text for r in got if r.sid == "s2") == "13812345678"
    assert "".join(r.text for r in got if r.sid == "s3") == "{{PHONE_bcdfgh}}"
    assert sum(r.restored for r in got) == 3


def test_idle_sessions_give_out_what_they_hold(spark, tmp_path):
    schema = "sid string, channel string, seq long, text string, final boolean"
    spark.createDataFrame([("s1", "c", 0, "call {{PHONE_", False)], schema).write.parquet(f"{tmp_path}/in")
    chunks = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = restore.restore_stream(chunks, sessions(spark, "s1"), idle_ms=500).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            got = spark.table("idle").orderBy("seq").collect()
            if len(got) > 1:
                break
        assert [r.text for r in got] == ["call ", "{{PHONE_"]
    finally:
        q.stop()


def sse(*events, end=True):
    return "".join(f"data: {json.dumps(e, ensure_ascii=False)}\n\n" for e in events) + ("data: [DONE]\n\n" if end else "")


def chat(text, **more):
    return {"choices": [{"index": 0, "delta": {"content": text}, **more}]}


SHAPES = {
    "chat": ("sse", [chat("call {{PHO"), chat("NE_bcdfgh}} now"), chat("", finish_reason="stop")], "c0.content", "call 13812345678 now"),
    "chat held at the end": ("sse", [chat("call {{PHONE_bcd"), chat("", finish_reason="stop")], "c0.content", "call {{PHONE_bcd"),
    "tool": ("sse", [{"choices": [{"delta": {"tool_calls": [{"index": 0, "function": {"arguments": p}}]}}]} for p in ('{"p":"{{PHONE', '_bcdfgh}}"}')], "c0.tool0", '{"p":"13812345678"}'),
    "blocks": ("sse", [{"type": "content_block_delta", "index": 1, "delta": {"text": p}} for p in ("mail {{EMAIL_", "zzzzzz}}")] + [{"type": "content_block_stop", "index": 1}], "a1.text", "mail a@b.cn"),
    "responses": ("sse", [{"type": "response.output_text.delta", "output_index": 0, "item_id": "m", "delta": p} for p in ("x {", "{PHONE_bcdfgh}}", " TERM_")], "r0.text@m", "x 13812345678 TERM_"),
    "lines": ("ndjson", [{"message": {"content": p}, "done": False} for p in ("call {{PHONE", "_bcdfgh}}")] + [{"message": {"content": ""}, "done": True}], "o.message.content", "call 13812345678"),
    "unknown field": ("sse", [{"choices": [{"delta": {"speech": p}}]} for p in ("{{PHONE_b", "cdfgh}}")], "c0.xspeech", "13812345678"),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_streams_of_all_shapes_in_pieces_of_any_size(name, size):
    framing, events, channel, want = SHAPES[name]
    body = sse(*events) if framing == "sse" else "".join(json.dumps(e) + "\n" for e in events)
    data = body.replace("\n", "\r\n").encode() if size == 7 else body.encode()
    session, out = restore.Session(), ""
    for i in range(0, len(data), size):
        out += session.push(data[i : i + size], framing, KNOWN, False)
    out += session.push(b"", framing, KNOWN, True)
    found = [json.loads(x[6:] if framing == "sse" else x) for x in out.splitlines() if (x.startswith("data: {") if framing == "sse" else x)]
    got = "".join(s.text for e in found for s in frames.text_slots(e) if s.channel == channel)
    assert got == want and (framing == "ndjson" or out.rstrip().endswith("[DONE]"))
    assert not session.pending and not session.buffer


def test_characters_cut_between_chunks_and_frames_that_are_no_json():
    session = restore.Session()
    data = "data: 收到 {{PHONE_bcdfgh}} 谢谢\n\nevent: ping\n\n: note\n\ndata: [1, \"{{EMAIL_zzzzzz}}\"]\n\n".encode()
    out = "".join(session.push(data[i : i + 1], "sse", KNOWN, False) for i in range(len(data))) + session.push(b"", "sse", KNOWN, True)
    assert out == 'data: 收到 13812345678 谢谢\n\nevent: ping\n\n: note\n\ndata: [1, "a@b.cn"]\n\n'


def test_stream_of_chunks(spark, tmp_path):
    framing, events, _, _ = SHAPES["chat"]
    data = sse(*events).encode()
    rows = [("s1", i, framing, data[20 * i : 20 * i + 20], 20 * i + 20 >= len(data)) for i in range(-(-len(data) // 20))]
    schema = "sid string, seq long, framing string, chunk binary, final boolean"
    for k in range(2):
        spark.createDataFrame(rows[1 - k :: 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = restore.restore_frames(chunks, sessions(spark, "s1"), idle_ms=None).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert "13812345678" in "".join(json.loads(x[6:])["choices"][0]["delta"]["content"] for x in "".join(r.text for r in got).splitlines() if x.startswith("data: {"))
    assert sum(r.restored for r in got) == 1 and sum(r.unresolved for r in got) == 0


def test_ends_and_merged_calls_and_usage():
    assert frames.ends({"done": True}) is None and frames.ends({"type": "message_stop"}) is None and frames.ends([]) == []
    assert frames.ends({"choices": [{"finish_reason": ""}, {"index": 3, "finish_reason": "stop"}]}) == ["c3."]
    data = {"choices": [{"delta": {"tool_calls": [{"index": 0, "id": "", "function": {"name": "f", "arguments": "{"}}, {"index": 0, "id": "x", "function": {"name": "g", "arguments": "}"}}]}}]}
    frames.merge_tool_calls(data)
    assert data["choices"][0]["delta"]["tool_calls"] == [{"index": 0, "id": "x", "function": {"name": "f", "arguments": "{}"}}]
    assert frames.usage_of({"message": {"usage": {"input_tokens": 3, "output_tokens": -1}}}) == (3, 0)
    assert frames.usage_of({"usage": {"total_tokens": 9}}) == (9, 0) and frames.usage_of({}) == (0, 0)
    assert frames.usage_of_body('data: {"usage":{"prompt_tokens":1}}\n\ndata: {"usage":{"completion_tokens":2,"prompt_tokens":0}}\n\ndata: [DONE]') == (1, 2)
    assert frames.model_of_response('data: {"message":{"model":"m"}}') == "m" and frames.model_of_response("{}") is None
    assert [s.channel for s in frames.snapshot_slots({"type": "t", "arguments": "a", "response": {"output": [{"arguments": "b"}]}, "choices": [{"message": {"tool_calls": [{"function": {"arguments": "c"}}]}}]})] == ["s.t.arguments", "s.response.output0.arguments", "s.c0.tool0"]


def test_protocols_and_dialogs():
    first = [{"role": "user", "content": "x"}]
    for path, body, want in (("/v1/messages", {"messages": first, "max_tokens": 1}, "anthropic"), ("", {"messages": first}, "chat"), ("", {"input": None}, "responses"), ("/v1/responses", {"instructions": "a"}, "responses"), ("", {"messages": []}, "unknown"), ("/v1/completions", {"prompt": "x"}, "chat"), ("", [1], "unknown")):
        assert frames.protocol(path, body) == want
    assert frames.dialog({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"text": " "}]}, {"content": "b"}], "input": "c"}) == "a\nb\nc"
    assert frames.dialog({"text": "y" * 9000}).startswith("y" * 8000 + "\n")
    for kind in ("chat", "anthropic", "responses"):
        assert frames.protocol("/messages" if kind == "anthropic" else "", json.loads(frames.wrapped(kind, "m", "hi"))) == kind


def test_rollups_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    restore.append_with_rollups(stream, f"{tmp_path}/log", f"{tmp_path}/roll", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/log").count() == events.count()
    rolled = spark.read.parquet(f"{tmp_path}/roll").groupBy("day", "event_type").agg(F.sum("count").alias("n"))
    want = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, rolled.collect())) == sorted(map(tuple, want.collect()))
    daily = restore.daily_rollup(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    daily.awaitTermination(120)
    assert spark.table("daily").agg(F.sum("n")).first()[0] == events.count()


def test_duplicate_keys_and_decompression(spark):
    rows = [('{"a":1,"a":2}', True), ('{"a":{"b":1,"b":1}}', True), ('[{"a":1},{"a":1}]', False), ("{", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", udfs.duplicate_keys("t").alias("got")).collect())
    data = b"hello " * 50
    bodies = [(udfs.compress(data, "gzip") * 2, "GZIP ", data * 2), (udfs.compress(data, "deflate"), "deflate", data), (data, "identity", data), (data, "br", None), (b"junk", "gzip", None), (None, "gzip", None)]
    df = spark.createDataFrame(bodies, "b binary, e string, want binary")
    assert all(r.got == r.want for r in df.select("want", udfs.decompress("b", "e", 1000).alias("got")).collect())
    assert udfs.decompressed(udfs.compress(data, "gzip"), "gzip", 100) is None


BODY = '{"model":"m", "max_tokens":5,"a": 1.10, "a":"13812345678","messages":[{"role":"user","content":"call 13812345678"}],"input":{"id":13812345678,"n":7},"cache_control":{"k":"13812345678"},"phones":{"1":"13812345678"},"13812345678":1e5}'


def masker(**more):
    return M.Masker(M.Settings(**more), "k")


def test_leaves_and_exemptions(spark):
    df = spark.createDataFrame([("r1", BODY), ("r2", "no json"), ("r3", None), ("r4", "[]")], "row_id string, body string")
    found = B.leaves(df).where("kind <> 'key'").orderBy("row_id", "ord").collect()
    assert [(r.key, r.kind, r.in_business, r.exempt) for r in found] == [
        ("model", "string", False, True), ("max_tokens", "number", False, True), ("a", "number", False, False), ("a", "string", False, False), ("role", "string", False, True),
        ("content", "string", False, False), ("id", "number", True, False), ("n", "number", True, False), ("k", "string", False, True), ("1", "string", False, False), ("13812345678", "number", False, False),
    ]
    assert [r.path for r in found][-2] == ["phones", "1"]


def test_masked_bodies_keep_all_other_bytes():
    got = json_spans.masked(BODY, masker())
    token = got.hits["PHONE", "13812345678"]
    want = BODY.replace('"a":"13812345678"', f'"a":"{token}"').replace("call 13812345678", f"call {token}").replace('"id":13812345678', f'"id":"{token}"').replace('{"1":"13812345678"}', f'{{"1":"{token}"}}').replace('"13812345678":1e5', f'"{token}":1e5')
    assert got.text == want and json_spans.masked('{"x": [1, "y"] }', masker()).text == '{"x": [1, "y"] }'
    back = json_spans.restored(got.text, restore.by_suffix({token: "13812345678"}))
    assert back.text == BODY.replace('"id":13812345678', '"id":"13812345678"') and back.unresolved == 0


def test_json_within_arguments_escapes_and_embedded_files():
    blob = "data:image/png;base64," + "QUJD" * 10
    body = json.dumps({"tools": [{"function": {"name": "f", "arguments": json.dumps({"who": "张三 13812345678"})}}], "content": blob, "text": "张三"})
    got = json_spans.masked(body, masker(words=(("张三", "NAME"),)))
    inner = json.loads(json.loads(got.text)["tools"][0]["function"]["arguments"])["who"]
    assert "张三" not in inner and "13812345678" not in inner and json.loads(got.text)["content"] == blob and "\\u" not in got.text.replace("\\\\u", "")
    back = json_spans.restored(got.text, restore.by_suffix({t: v for (_, v), t in got.hits.items()})).text
    whole = lambda t: {**(d := json.loads(t)), "tools": json.loads(d["tools"][0]["function"]["arguments"])}
    assert whole(back) == whole(body)
    assert json_spans.masked('{"a":"\\u5f20 13812345678"}', masker()).text.startswith('{"a":"\\u5f20 {{PHONE_')
    slim, found, size = blobs.taken_out(body)
    assert len(found) == 1 and size == len(blob) and blob not in slim and blobs.put_back(slim, found) == body and blobs.put_back("{}", found) is None
    assert blobs.kind("a" * 9000) is None and blobs.kind("Ab1+" * 3000) == "base64" and blobs.kind("0123456789abcdef" * 600) is None and blobs.kind(blob) == "data_uri"


def test_depth_and_what_is_no_json(spark):
    deep = '{"a":' * 30 + '"13812345678"' + "}" * 30
    rows = [("a", deep), ("b", "{"), ("c", None), ("d", '"13812345678"'), ("e", "[]")]
    got = {r.row_id: (r.status, r.text) for r in masking.mask_bodies(spark.createDataFrame(rows, "row_id string, text string"), key="k").collect()}
    assert got["a"] == ("json_depth_exceeded", deep) and got["b"] == ("invalid", "{") and got["c"] == ("invalid", None) and got["e"] == ("unchanged", "[]")
    assert got["d"][0] == "masked" and got["d"][1].startswith('"{{PHONE_')


def test_restored_trees():
    known = restore.by_suffix({"{{TERM_bcdfgh}}": 'a"b', "{{TERM_zzzzzz}}": "k"})
    text = '{"x":"{{TERM_bcdfgh}}","arguments":"{\\"p\\":\\"{{TERM_bcdfgh}}\\"}","{{TERM_zzzzzz}}":1,"k":2,"encrypted_content":"TERM_bcdfgh"}'
    got = json_spans.restored(text, known)
    data = json.loads(got.text)
    assert data["x"] == 'a"b' and json.loads(data["arguments"]) == {"p": 'a"b'} and "{{TERM_zzzzzz}}" in data and data["encrypted_content"] == "TERM_bcdfgh"


def test_bodies_hold_whole_texts(spark, tmp_path):
    text = "words of a long turn " * 60 + "call 13900001111 now"
    spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    body = json_queries.bodies(spark, str(tmp_path)).first().body
    assert json.loads(body)["messages"][0]["content"] == f"{text} call 13900000100"
    assert [tuple(r[k] for k in ("n_tokens", "n_values", "valid")) for r in json_queries.tree_masked(spark, str(tmp_path)).collect()] == [(3, 2, True)]


def test_slots_of_streams_are_looked_for_once(spark, tmp_path):
    rows = [(1, 0, "user", "twelve chars and more of them"), (1, 1, "assistant", ""), (2, 0, "user", None), (None, 1, None, "no number"), (None, None, None, "neither"), (3, 2, "user", "é漢字 \"q\" \\ " * 9), (3, 2, "user", "é漢字 \"q\" \\ " * 9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = json_queries.slot_texts(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    events = json_queries._events(spark, str(tmp_path)).withColumn("row_id", F.struct("sid", "seq"))
    flat = B.slots(events).select("row_id.sid", "row_id.seq", "ord", "channel", "text", "ends")
    ends = flat.groupBy("sid").agg(F.sum(F.col("ends").cast("long")).alias("n_ends"))
    apart = B.channel_texts(flat).join(ends, "sid").select("sid", "channel", F.sha2("text", 256).alias("digest"), "n_ends")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.collect())) and got.count() == 5


def test_channel_texts_with_other_aggregates(spark):
    rows = [("s", 1, 0, "a", "y", True), ("s", 0, 1, "a", "x", False), ("s", 0, 0, "b", None, None), ("s", 1, 1, "b", "z", True), (None, 0, 0, "a", "n", True), ("t", 0, 0, None, "o", None)]
    found = spark.createDataFrame(rows, "sid string, seq int, ord int, channel string, text string, ends boolean")
    got = B.channel_texts(found, F.sum(F.col("ends").cast("long")).alias("n")).collect()
    assert {tuple(r) for r in got} == {("s", "a", "xy", 1), ("s", "b", "z", 1), (None, "a", "n", 1), ("t", None, "o", None)}


def test_ends_of_a_stream_count_over_all_its_channels(spark, monkeypatch):
    delta = lambda end=None, **own: json.dumps({"choices": [{"delta": own, "finish_reason": end}]})
    call = lambda text: [{"index": 0, "function": {"arguments": text}}]
    rows = [("a", 0, delta(content="x", reasoning="r")), ("a", 1, delta(tool_calls=call("{"))), ("a", 2, delta("stop", content="y", tool_calls=call("}"))), ("b", 0, delta(content="only")), ("b", 1, "no JSON"), ("b", 2, None), (None, 0, delta("stop", content="lost"))]
    monkeypatch.setattr(json_queries, "_events", lambda spark, sf_dir: spark.createDataFrame(rows, "sid string, seq int, data string").repartition(3))
    got = json_queries.slot_texts(spark, "").select("sid", "channel", "n_ends", "digest").collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert {tuple(r) for r in got} == {("a", "c0.content", 2, sha("xy")), ("a", "c0.reason2", 2, sha("r")), ("a", "c0.tool0", 2, sha("{}")), ("b", "c0.content", 0, sha("only"))}
