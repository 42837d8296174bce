"""Responses that come in pieces: commands held back, whole bodies restored, chunks decoded, texts kept, mappings over time."""

import gzip
import json
import random
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from sievemark.functions import frames
from sievemark.functions import patterns as P
from sievemark.functions.decoding import Decoder
from sievemark.functions.transducers import Guard
from sievemark.operators import commands as whole_commands
from sievemark.operators import decoding, responses
from sievemark.plans import stream_queries
from sievemark.streaming import commands, mapping, restore

TEXTS = [
    "x sudo rm -rf / ; and then drop table users;", "rm -rf /tmp/x", "rm -rf /", "a rm --no-preserve-root / foo bar/ baz", "dd if=/dev/zero of=/dev/sda rm -rf ~", "format c: DROP  DATABASE x", "rm rm rm -rf /", "; del /s c:\\ x",
    "erase /q  D:\\", ":(){ :|:& };: ok", "Remove-Item a -Recurse -Force C:\\ z", "mkfs.ext4 /dev/sdb mkfs /dev/", "rm -r -f / rm -rf /*", 'rmdir rm -rf /usr; rm -rf "/"', "drop tablet drop table", "é" * 30 + "rm -rf /", "", "nothing",
]


def rewritten(text):
    for _, _, pattern in P.COMMANDS:
        text = regex.sub(pattern.replace(r"\z", r"\Z"), lambda m: P.NOTICE, text)
    return text


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("hold", [64, 500])
def test_every_split_gives_the_rewritten_whole(text, hold):
    guard = Guard(hold=hold)
    for a in range(len(text) + 1):
        for b in {a, a + 1, a + 4, len(text)}:
            if a <= b <= len(text):
                states = []
                out = [guard.feed(states, p, last)[0] for p, last in ((text[:a], False), (text[a:b], False), (text[b:], True))]
                assert "".join(out) == rewritten(text)
                assert all(h == "" for _, h in states)
    states = []
    assert "".join(guard.feed(states, c, False)[0] for c in text) + guard.feed(states, "", True)[0] == rewritten(text)


def test_what_is_held_is_bounded():
    guard, states, size = Guard(hold=64), [], 0
    for _ in range(500):
        guard.feed(states, "rm -rf -rf ", False)
        size = max(size, sum(len(h.encode()) for _, h in states))
    assert size <= 64 * len(guard.stages)
    # beyond the limit a command whose start has gone is let go, and none is invented
    states = []
    out = "".join(guard.feed(states, c, False)[0] for c in "rm " + "-r " * 40 + "/ x") + guard.feed(states, "", True)[0]
    assert out == "rm " + "-r " * 40 + "/ x"


@pytest.mark.parametrize("mode", ["observe", "rewrite", "block"])
def test_sessions_in_all_modes_for_every_split(mode):
    text = "a b; rm -rf / ; more text after it"
    how = commands.How(mode)
    for a in range(len(text) + 1):
        session, guard, out, hits, blocked = commands.Session(), how.guard(), "", [], False
        for piece, last in ((text[:a], False), (text[a:], False), ("", True)):
            kind, shown, stopped, found = session.piece(guard, how, "c0.tool0", piece, last, set())
            out, blocked = out + shown, blocked or stopped
            hits += found
        assert [h.id for h in hits] == ["builtin-rm-root"] and hits[0].snippet == "rm -rf /"
        if mode == "block":
            assert blocked and text.startswith(out) and len(out) <= text.index("rm") and session.piece(guard, how, "c1.tool0", "other", True, set())[1:3] == ("", True)
            assert session.piece(guard, how, "c0.content", "plain", True, set())[1] == "plain"
        else:
            assert not blocked and out == (text if mode == "observe" else rewritten(text))


def test_echoes_allowed_commands_and_kinds():
    how = commands.How("rewrite", allow=(r"/ *\Z",))
    session, guard = commands.Session(), how.guard()
    assert session.piece(guard, how, "c0.tool0", "rm -rf / ", True, set())[1] == "rm -rf / "
    how = commands.How("rewrite")
    guard = how.guard()
    assert session.piece(guard, how, "c0.tool0", "rm -rf / ", True, {"rm -rf /"})[1::2] == ("rm -rf / ", [])
    kind, text, stopped, hits = session.piece(guard, how, "c0.reason", "rm -rf / ", True, set())
    assert (kind, text, stopped, [h.snippet for h in hits]) == ("reason", "rm -rf / ", False, ["rm -rf /"])
    assert session.piece(guard, how, "c0.content", "rm -rf / ", True, set())[3] == []


def test_kinds_are_those_of_columns(spark):
    names = ["c0.tool0", "c0.content", "c0.reason", "a0.pj", "r0.args@x", "c0.xtool_result", "o.message.xname", "c1.fcall", "a1.think", "o.message.tool3", "c0.toolbox", "arguments", "tool_use_id", "X.Tool", ""]
    got = spark.createDataFrame([(n,) for n in names], "c string").select("c", whole_commands.channel_kind(F.col("c")).alias("k")).collect()
    assert {r.c: r.k for r in got} == {n: commands.kind_of(n) for n in names}


def _pieces(rng):
    rows = []
    for i, text in enumerate(TEXTS * 2):
        seq, at = 0, 0
        while at < len(text):
            size = rng.randint(1, 9)
            rows.append((f"s{i}", "c0.tool0", seq, text[at : at + size], at + size >= len(text) and i % 2 == 0))
            at, seq = at + size, seq + 1
    return rows


def test_guarded_table_and_stream_are_alike(spark, tmp_path):
    rows = _pieces(random.Random(3))
    schema = "sid string, channel string, seq long, text string, final boolean"
    for k in range(3):  # out of order over the batches
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    echo = spark.createDataFrame([("s2", ["rm -rf /"])], "sid string, snippets array<string>")
    batch = commands.guard_pieces(spark.createDataFrame(rows, schema).repartition(5), echoes=echo).collect()
    stream = commands.guard_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), echoes=echo, idle_ms=None)
    query = stream.writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = spark.table("guarded").collect()

    def joined(found, only=lambda s: True):
        out = {}
        for r in sorted(found, key=lambda r: (r.sid, r.seq)):
            if only(r.sid):
                out[r.sid] = out.get(r.sid, "") + r.text
        return out

    want = {f"s{i}": t if i == 2 else rewritten(t) for i, t in enumerate(TEXTS * 2) if t}
    assert joined(batch) == want
    ended = lambda s: int(s[1:]) % 2 == 0
    assert joined(streamed, ended) == {s: t for s, t in want.items() if ended(s)}


def _bodies(token):
    text = f"call {token} or {token} now"
    cut = [text[i : i + 4] for i in range(0, len(text), 4)]
    inner = json.dumps({"q": text})
    args = [inner[i : i + 5] for i in range(0, len(inner), 5)]
    sse = lambda events, ends, sep="\n\n": sep.join(f"data: {json.dumps(e)}" for e in events) + sep + sep.join(ends) + sep
    return {
        "chat": ("text/event-stream", sse([{"choices": [{"index": 0, "delta": {"content": p}}]} for p in cut], ['data: {"choices":[{"index":0,"finish_reason":"stop"}]}', "data: [DONE]"])),
        "chat_crlf": ("text/event-stream", sse([{"choices": [{"index": 0, "delta": {"content": p}}]} for p in cut], ["data: [DONE]"], "\r\n\r\n")),
        "calls": ("text/event-stream", sse([{"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 0, "function": {"arguments": p}}]}}]} for p in args], ["data: [DONE]"])),
        "blocks": ("text/event-stream", sse([{"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": p}} for p in cut], ['data: {"type":"content_block_stop","index":0}'])),
        "items": ("text/event-stream", sse([{"type": "response.output_text.delta", "item_id": "m", "delta": p} for p in cut], ['data: {"type":"response.completed"}'])),
        "lines": ("application/x-ndjson", "".join(json.dumps({"message": {"content": p}, "done": False}) + "\n" for p in cut) + '{"done":true}\n'),
        "wrong_type": ("application/json", sse([{"choices": [{"index": 0, "delta": {"content": p}}]} for p in cut], ["data: [DONE]"])),
        "cut_off": ("text/event-stream", sse([{"choices": [{"index": 0, "delta": {"content": p}}]} for p in cut[:4]], ["data: "])),
    }


def test_whole_bodies_are_what_the_stream_gives_for_any_cut(spark, tmp_path):
    token, value = "{{PHONE_bcdfgh}}", 'say "1\\2"'
    bodies = _bodies(token)
    rows = [(name, kind, body) for name, (kind, body) in bodies.items()] + [("json", "application/json", json.dumps({"a": token, "b": 1})), ("broken", "application/json", '{"a": "C:\\work ' + token), ("plain", "", f"x {token}"), ("binary", "image/png", token), ("none", "text/plain", None)]
    known = spark.createDataFrame([(token, value)], "token string, value string")
    got = {r.row_id: r for r in responses.restore_bodies(spark.createDataFrame(rows, "row_id string, content_type string, text string").repartition(3), known).collect()}
    assert json.loads(got["json"].text) == {"a": value, "b": 1} and got["plain"].text == f"x {value}" and got["broken"].text.endswith(value) and got["binary"].text == token and got["none"].text is None
    for name, (kind, body) in bodies.items():
        events = frames.events_of(got[name].text)
        joined = "".join(s.text for e in events for s in frames.text_slots(e))
        assert token not in got[name].text
        if name == "calls":
            assert json.loads(joined) == {"q": f"call {value} or {value} now"}
        elif name != "cut_off":
            assert joined == f"call {value} or {value} now" and got[name].restored == 2
        framing = "ndjson" if name == "lines" else "sse"
        for size in (1, 3, 7, 64, 10**6):
            session, data = restore.Session(), body.encode()
            parts = [data[i : i + size] for i in range(0, len(data), size)]
            out = "".join(session.push(p, framing, restore.by_suffix({token: value}), False) for p in parts) + session.push(b"", framing, restore.by_suffix({token: value}), True)
            assert out == got[name].text, (name, size)


def test_bodies_without_a_session_stay(spark):
    rows = spark.createDataFrame([("a", "text/event-stream", 'data: {"choices":[{"delta":{"content":"{{PHONE_bcdfgh}}"}}]}\n\n', False)], "row_id string, content_type string, text string, known boolean")
    r = responses.restore_bodies(rows, spark.createDataFrame([("{{PHONE_bcdfgh}}", "1")], "token string, value string")).first()
    assert "{{PHONE_bcdfgh}}" in r.text and (r.restored, r.unresolved) == (0, 1)


PLAIN = "héllo 漢字 \U0001f600 " * 40


@pytest.mark.parametrize("encoding,data", [
    ("gzip", gzip.compress(PLAIN.encode())), ("x-gzip", gzip.compress(PLAIN.encode()[:100]) + gzip.compress(PLAIN.encode()[100:])), ("deflate", zlib.compress(PLAIN.encode())),
    (" Deflate ", zlib.compressobj(wbits=-15).compress(PLAIN.encode()) + b""), (None, PLAIN.encode()), ("identity", PLAIN.encode()),
])
def test_any_cut_decodes_to_the_whole(encoding, data):
    if encoding == " Deflate ":
        packer = zlib.compressobj(wbits=-15)
        data = packer.compress(PLAIN.encode()) + packer.flush()
    for size in (1, 2, 3, 5, 17, 10**6):
        d = Decoder(encoding)
        assert "".join(d.push(data[i : i + size]) for i in range(0, len(data), size)) + d.finish() == PLAIN and d.status == "ok"


def test_zstd_chunks():
    zstandard = pytest.importorskip("zstandard")
    data = zstandard.ZstdCompressor().compress(PLAIN.encode())
    for size in (1, 7, 1000):
        d = Decoder("zstd")
        assert "".join(d.push(data[i : i + size]) for i in range(0, len(data), size)) + d.finish() == PLAIN and d.status == "ok"


def test_bombs_stop_at_the_cap_and_broken_bodies_are_told():
    bomb, d = gzip.compress(b"0" * 50_000_000), Decoder("gzip", cap=1_000_000)
    taken = sum(len(d.push(bomb[i : i + 100])) for i in range(0, len(bomb), 100))
    assert d.status == "too_long" and taken <= 1_000_000 and d.size < 1_200_000
    whole = Decoder("gzip", cap=1_000_000)
    assert whole.push(bomb) == "" and whole.status == "too_long" and whole.size <= 1_000_000 + (1 << 16)
    early = Decoder("gzip")
    early.push(gzip.compress(PLAIN.encode())[:30])
    assert early.finish() == "" and early.status == "broken"
    assert Decoder("br").status == "unknown"
    bad = Decoder("gzip")
    assert bad.push(b"no gzip at all") == "" and bad.status == "broken"


def test_chunk_tables(spark):
    data = gzip.compress(PLAIN.encode())
    rows = [("a", i, "gzip", data[i * 7 : i * 7 + 7]) for i in range(len(data) // 7 + 1)] + [("b", 0, "", "é".encode()[:1]), ("b", 1, "", "é".encode()[1:]), ("b", 2, "", None), ("c", 0, "gzip", data[:20]), ("d", 0, "br", b"x"), ("e", 0, "", b"\xff")]
    got = decoding.decoded_chunks(spark.createDataFrame(rows, "sid string, seq long, encoding string, chunk binary").repartition(4)).orderBy("sid", "seq").collect()
    joined = {}
    for r in got:
        joined[r.sid] = (joined.get(r.sid, ("",))[0] + r.text, r.status)
    assert joined == {"a": (PLAIN, "ok"), "b": ("é", "ok"), "c": ("", "broken") if joined["c"][0] == "" else (joined["c"][0], "broken"), "d": ("", "unknown"), "e": ("\ufffd", "ok")}


def test_kept_texts_are_the_first_bytes(spark):
    rng = random.Random(2)
    rows = [(s, i, 0, rng.choice([None, "", "é" * rng.randint(0, 9), "x" * rng.randint(0, 20)])) for s in "abc" for i in range(60)] + [("n", 0, 0, None)]
    df = spark.createDataFrame(rows, "sid string, seq long, ord int, text string").repartition(5)
    for most in (0, 1, 10, 33, 10**6):
        got = {r.sid: r.text for r in responses.kept_texts(df, most=most).collect()}
        for s in "abcn":
            whole = "".join(t or "" for x, *_, t in sorted(rows, key=lambda r: r[:2]) if x == s).encode()
            assert got[s] == whole[:most].decode(errors="ignore")


def test_use_extends_a_mapping(spark, tmp_path):
    day = "2024-03-01 "
    uses = [("EMAIL", "a@b.cn", "{{EMAIL_bcdfgh}}", day + f"{h:02d}:00:00") for h in (0, 1, 2, 3)] + [("EMAIL", "x@y.cn", "{{EMAIL_ghjkmn}}", day + "00:00:00"), ("EMAIL", "late@y.cn", "{{EMAIL_zzzzzz}}", day + "09:00:00"), ("EMAIL", None, "t", day + "00:00:00")]
    df = spark.createDataFrame(uses, "label string, value string, token string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda t: {(r.value, r.uses) for r in mapping.live_at(df, F.lit(day + t).cast("timestamp"), 3600).collect()}
    assert at("01:00:00") == {("a@b.cn", 2), ("x@y.cn", 1)} and at("01:00:01") == {("a@b.cn", 2)} and at("04:00:00") == {("a@b.cn", 4)} and at("04:00:01") == set()
    lives = {(r.value, str(r.born)[11:], str(r.touched)[11:], r.uses) for r in mapping.lifetimes(df, 3599).collect()}
    assert {x for x in lives if x[0] == "a@b.cn"} == {("a@b.cn", f"{h:02d}:00:00", f"{h:02d}:00:00", 1) for h in (0, 1, 2, 3)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = mapping.expired_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3600)
    query = stream.writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    ended = {(r.value, str(r.touched)[11:], r.uses) for r in spark.table("expired").collect()}
    assert ended == {("a@b.cn", "03:00:00", 4), ("x@y.cn", "00:00:00", 1)}  # the last one lives as far as the watermark knows


def test_lifetimes_equal_a_plain_loop(spark):
    rng = random.Random(8)
    uses = [(rng.choice("LM"), rng.choice(["p", "q"]), "t", rng.randint(0, 5000)) for _ in range(400)]
    df = spark.createDataFrame(uses, "label string, value string, token string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for ttl in (1, 7, 40):
        want = []
        for key in {u[:2] for u in uses}:
            times, run = sorted(u[3] for u in uses if u[:2] == key), []
            for t in times:
                if run and t - run[-1] > ttl:
                    want.append((*key, run[0], run[-1], len(run)))
                    run = []
                run.append(t)
            want.append((*key, run[0], run[-1], len(run)))
        got = mapping.lifetimes(df, ttl).select("label", "value", F.unix_seconds("born"), F.unix_seconds("touched"), "uses").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_warm_start_takes_the_newest_and_no_nested_ones(spark):
    log = [(1, "EMAIL", "a", "{{EMAIL_bcdfgh}}"), (5, "EMAIL", "a", "{{EMAIL_ghjkmn}}"), (2, "PHONE", "b", "{{PHONE_bcdfgh}}"), (9, "PHONE", "{{PHONE_bcdfgh}}", "{{PHONE_zzzzzz}}"), (8, "PHONE", "", "t"), (7, "PHONE", "c", ""), (6, None, "d", "{{TERM_bcdfgh}}"), (3, "X", None, "t")]
    got = mapping.warm_start(spark.createDataFrame(log, "event_id long, label string, value string, token string"), 2).orderBy("rank").collect()
    assert [(r.label, r.value, r.token, r["rank"]) for r in got] == [(None, "d", "{{TERM_bcdfgh}}", 1), ("EMAIL", "a", "{{EMAIL_ghjkmn}}", 2)]


def test_sessions_joined_as_judged_are_those_of_their_pieces(spark):
    rows = _pieces(random.Random(5))
    rows += [(None, "c0.tool0", i, t, False) for i, t in enumerate(["rm -r", None, "f / ", ""])]  # without an end or a number of its own
    rows += [r for r in rows for _ in range(2) if r[0] in ("s0", "s3", None)]  # rows that come more than once
    rows += [("empty", "c0.tool0", 0, None, True), ("other", "c0.content", 0, "rm -rf / ", True), ("thought", "c0.reason", None, "rm -rf / ", True), ("two", "c0.tool0", 0, "rm -rf", False), ("two", "c0.tool1", 1, "rm -rf / ", False)]
    pieces = spark.createDataFrame(rows, "sid string, channel string, seq long, text string, final boolean").repartition(5)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    for mode in ("rewrite", "block", "observe"):
        apart = commands.guard_pieces(pieces, commands.How(mode)).groupBy("sid").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"), F.bool_or(F.size("hits") > 0).alias("hit"))
        joined = commands.guard_pieces(pieces, commands.How(mode), joined=True)
        assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, apart.collect()), key=repr)


def test_guarded_pieces_are_dealt_out_once(spark):
    plan = stream_queries.guarded(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(sid") == 1 and "Aggregate" not in plan
