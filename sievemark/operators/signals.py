"""Signals in responses, as findings: row_id, signal, severity, kind and evidence. All in Spark's own expressions, one scan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames
from ..functions import patterns as P
from ..functions import texts as T
from . import containment

RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
FINDING = "array<struct<signal: string, severity: string, kind: string, evidence: string>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _finding(signal: str, severity, kind, evidence: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(signal).alias("signal"), as_column(severity).alias("severity"), as_column(kind).alias("kind"), evidence.alias("evidence"))


def _one(condition: Column, finding: Column) -> Column:
    """A list of one finding, or of none."""
    return F.when(condition, F.array(finding)).otherwise(F.array().cast(FINDING))


def _holds(low: Column, words: tuple[str, ...]) -> Column:
    some = F.lit(False)
    for w in words:
        some = some | F.contains(low, F.lit(w))
    return some


def _where(condition: Column, parts: list[Column]) -> list[Column]:
    """``parts`` as one, worked out only for rows in which any can have a finding: most rows have none."""
    return [F.when(condition, F.concat(*[p.cast(FINDING) for p in parts])).otherwise(F.array().cast(FINDING))]


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def _rows(rows: DataFrame, parts: list[Column]) -> DataFrame:
    """Findings of each row, equal ones once, with their number where it is more than one, in order of first occurrence."""
    each = rows.select("row_id", F.posexplode(F.concat(*[p.cast(FINDING) for p in parts])).alias("ord", "f")).select("row_id", "ord", "f.*")
    same = each.groupBy("row_id", "signal", "kind", "evidence").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"), F.first("severity").alias("severity"))
    shown = F.when(F.col("n") > 1, F.concat("evidence", F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("evidence"))
    return same.select("row_id", "ord", "signal", "severity", "kind", shown.alias("evidence"))


def error_leak(rows: DataFrame) -> DataFrame:
    """Credentials, variables, home paths and stack frames in error responses: ``rows`` of row_id, status, body and headers.

    Only a status of 400 or more is looked at. Probes of the gateway itself are no leaks; a variable's value counts from 20
    characters with an entropy of 3 bits that are no alphabet. Null texts are empty.
    """
    text = F.concat(F.coalesce("body", F.lit("")), F.lit("\n"), F.coalesce("headers", F.lit("")))
    return _rows(rows.where("status >= 400").select("row_id", text.alias("t")), _leak_parts(F.col("t")))


#: What a text must hold for a credential shape to hit, where that is cheap to tell.
_MARKS = {"sk_prefix_secret": "sk-", "bearer_token": "Bearer", "google_api_key": "AIza", "google_key_url_param": "key=", "gcp_oauth_token": "ya29.", "jwt_token": "eyJ", "pem_private_key": "PRIVATE KEY", "db_connstring_password": "://", "slack_token": "xox", "aliyun_ak": "LTAI", "tencent_ak": "AKID", "aws_ak": "AKIA", "jwt": "eyJ", "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "stripe_key": ("k_live_", "k_test_"), "aws_access_key": ("AKIA", "ASIA")}
_MARKS |= {"env_var": ("_KEY", "_TOKEN", "_SECRET", "_PASSW", "_CREDENTIAL"), "fs_path": ("/home/", "/Users/", ":\\"), "stack_trace": ("File", "goroutine", "(")}


def _seen(text: Column, mark: str | tuple[str, ...] | None, pattern: str, group: int = 0) -> Column:
    """All matches, looked for only where the mark, or one of them, is."""
    found, some = _all(text, pattern, group), F.lit(False)
    for m in (mark,) if isinstance(mark, str) else mark or ():
        some = some | F.contains(text, F.lit(m))
    return F.when(some, found).otherwise(F.array().cast("array<string>")) if mark else found


def _leak_parts(t: Column) -> list[Column]:
    parts = []
    for kind, severity, pattern in P.SECRETS:
        bounded = rf"(?<![A-Za-z0-9_-]){pattern}" if kind == "sk_prefix_secret" else pattern
        snippets = F.transform(_seen(t, _MARKS.get(kind), bounded), lambda v: F.substring(v, 1, 80))
        probe = lambda v: F.exists(F.array(*[F.lit(m) for m in P.SELF_PROBES]), lambda m: F.contains(F.lower(v), m))
        parts.append(F.transform(F.filter(snippets, lambda v: ~probe(v)), lambda v: _finding("error_leak", severity, kind, T.evidence(v, F.lit(kind)))))  # noqa: B023
    pairs = F.arrays_zip(*[_seen(t, _MARKS["env_var"], f"({P.ENV_NAME})({P.ENV_VALUE})", k).alias(n) for k, n in ((1, "name"), (2, "value"))])
    real = F.filter(pairs, lambda x: (F.length(x["value"]) >= P.VALUE_CHARS) & (T.entropy(x["value"]) >= P.VALUE_ENTROPY) & ~T.ordered(x["value"]))
    parts.append(F.transform(real, lambda x: _finding("error_leak", "HIGH", "env_var", F.concat(F.lit("env_var: "), F.substring(x["name"], 1, 60)))))
    for kind, pattern in (("fs_path", P.HOME_PATH), ("stack_trace", P.STACK_FRAME)):
        parts.append(F.transform(_seen(t, _MARKS[kind], pattern), lambda v: _finding("error_leak", "LOW", kind, F.concat(F.lit(f"{kind}: "), F.substring(v, 1, 60)))))  # noqa: B023
    marks = {k: _MARKS[k] for k in (*(s[0] for s in P.SECRETS), "env_var", "fs_path", "stack_trace")}
    return _where(_holds(t, tuple(sorted({m for v in marks.values() for m in ((v,) if isinstance(v, str) else v)}))), parts)


def family(model: Column) -> Column:
    """The first word of a model's name, without its owner."""
    return F.regexp_extract(F.regexp_replace(F.lower(F.trim(model)), r"\A.*/", ""), r"\A([a-z0-9]*)", 1)


def tiers(model: Column) -> Column:
    """Size and kind words of a model's name, sorted, repeats kept."""
    words = F.split(F.regexp_replace(F.lower(F.trim(model)), r"\A.*/", ""), "[^a-z0-9]", -1)
    return F.array_sort(F.filter(words, lambda w: w.isin(P.TIERS)))


def identity_swap(rows: DataFrame) -> DataFrame:
    """Another model than was asked for: ``rows`` of row_id, asked and got. Another family is HIGH, another tier MEDIUM; blank names tell nothing."""
    return _rows(rows, _identity_parts(F.col("asked"), F.col("got")))


def _identity_parts(asked: Column, got: Column) -> list[Column]:
    a, b = F.trim(F.coalesce(asked, F.lit(""))), F.trim(F.coalesce(got, F.lit("")))
    named, same = (a != "") & (b != "") & (family(a) != "") & (family(b) != ""), family(a) == family(b)
    tier = lambda m: F.when(F.size(tiers(m)) == 0, " [none]").otherwise(F.concat(F.lit(" ["), F.array_join(tiers(m), ","), F.lit("]")))
    cut = lambda m: F.substring(m, 1, 60)
    other = F.concat(F.lit("model_mismatch: req="), cut(a), F.lit(" resp="), cut(b))
    level = F.concat(F.lit("model_tier_mismatch: req="), cut(a), tier(a), F.lit(" resp="), cut(b), tier(b))
    return [_one(named & ~same, _finding("identity_swap", "HIGH", "model_mismatch", other)), _one(named & same & (tiers(a) != tiers(b)), _finding("identity_swap", "MEDIUM", "model_tier_mismatch", level))]


def _unwrapped(text: Column) -> Column:
    bare = F.trim(text)
    fenced = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(bare, r"\A```[a-zA-Z]*\n|```\z", "")).otherwise(bare)
    return F.trim(F.regexp_replace(fenced, r"\A[\s>#$`\"']+|[\s`\"']+\z", ""))


def echo_class(expected: Column, actual: Column) -> Column:
    """exact, whitespace (or case) or substituted, quotes, prompts and fences aside."""
    e, a = _unwrapped(expected), _unwrapped(actual)
    words = lambda x: F.regexp_replace(x, r"\s+", " ")
    return F.when(e == a, "exact").when((words(e) == words(a)) | (F.lower(e) == F.lower(a)), "whitespace").otherwise("substituted")


def tool_call_rewrite(rows: DataFrame) -> DataFrame:
    """Tool calls that came back changed: ``rows`` of row_id, expected and actual; empty or null ones tell nothing."""
    verdict = echo_class(F.col("expected"), F.col("actual"))
    shown = F.concat(F.lit("expected='"), F.substring("expected", 1, 40), F.lit("' actual='"), F.substring("actual", 1, 40), F.lit("' verdict="), verdict)
    severity = F.when(verdict == "whitespace", "LOW").otherwise("MEDIUM")
    return _rows(rows, [_one((F.col("expected") != "") & (F.col("actual") != "") & (verdict != "exact"), _finding("tool_call_rewrite", severity, "tool_echo", shown))])


def stream_anomaly(events: DataFrame) -> DataFrame:
    """Oddities of event streams: ``events`` of row_id (the stream), seq, type and data (JSON).

    Up to six unknown event types unless the data has fields of another protocol; the first fall of output_tokens; input_tokens other
    than the last message_start told; empty signatures.
    """
    js = lambda p: F.get_json_object("data", p)
    keyed = F.lit(False)
    for k in P.STREAM_KEYS:
        keyed = keyed | js(f"$.{k}").isNotNull()
    delta, start = F.col("type") == "message_delta", F.col("type") == "message_start"
    out = F.when(delta, js("$.usage.output_tokens").try_cast("long"))
    into = F.when(delta, js("$.usage.input_tokens").try_cast("long"))
    first = F.when(start, F.coalesce(js("$.message.usage.input_tokens"), js("$.usage.input_tokens")).try_cast("long"))
    blank = delta & (F.trim(js("$.signature_delta")) == "")
    unknown = (F.col("type") != "") & ~F.col("type").isin(P.STREAM_EVENTS) & ~keyed
    flat = events.select("row_id", "seq", F.when(unknown, F.col("type")).alias("unknown"), out.alias("o"), into.alias("i"), first.alias("s"), blank.alias("b"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c])
    per = flat.groupBy("row_id").agg(listed("unknown").alias("unknown"), listed("o").alias("o"), listed("i").alias("i"), F.max_by("s", F.when(F.col("s").isNotNull(), F.col("seq"))).alias("s"), F.sum(F.col("b").cast("long")).alias("b"))
    return _rows(per, _anomaly_parts(*map(F.col, ("unknown", "o", "i", "s", "b"))))


def _anomaly_parts(unknown: Column, o: Column, i: Column, s: Column, b: Column) -> list[Column]:
    falls = F.filter(F.sequence(F.lit(1), F.greatest(F.size(o) - 1, F.lit(1))), lambda k: F.coalesce(F.get(o, k) < F.get(o, k - 1), F.lit(False)))
    at = F.get(falls, F.lit(0))
    text = lambda c: c.cast("string")
    return [
        F.transform(F.slice(unknown, 1, 6), lambda u: _finding("sse_anomaly", "LOW", "unknown_event", F.concat(F.lit("unknown_event: "), F.substring(u, 1, 40)))),
        _one(F.size(falls) > 0, _finding("sse_anomaly", "LOW", "usage_regress", F.concat(F.lit("output_tokens_regress: "), text(F.get(o, at - 1)), F.lit(" -> "), text(F.get(o, at))))),
        _one(
            F.coalesce(F.exists(i, lambda x: x != s), F.lit(False)),
            _finding("sse_anomaly", "LOW", "usage_inconsistent", F.concat(F.lit("input_tokens_inconsistent: first="), text(s), F.lit(" samples=["), F.array_join(F.slice(i, 1, 5).cast("array<string>"), ", "), F.lit("]"))),
        ),
        _one(b > 0, _finding("sse_anomaly", "LOW", "empty_signature", F.concat(F.lit("empty_signature_delta: "), text(b)))),
    ]


def response_poison(rows: DataFrame) -> DataFrame:
    """Hidden characters, addresses that leak when shown, credentials, fake turns, and instructions: ``rows`` of row_id, text and request.

    What the request (null: unknown) holds itself is no finding. An instruction to ignore others counts only beside another sign.
    Staged so that each text is cut into prose and code once.
    """
    return _rows(_staged(rows.where("text <> ''")), _poison_parts())


#: Words without which an instruction's pattern can't hit, in lower case.
_HINTS = {
    "prompt_extraction": ("prompt", "instruction", "system message", "提示", "消息", "指令", "设定", "输出", "显示", "给出", "告诉我"),
    "credential_exfil_instruction": ("http", "@"),
    "instruction_override": ("ignore", "disregard", "forget", "overrid", "overwrite", "bypass", "discard", "忽略", "无视", "忘记", "忘掉", "抛弃", "舍弃", "覆盖", "推翻", "绕过", "不必理会", "不要理会"),
}


#: Words of which a text must hold one as well.
_NEEDED = {
    "credential_exfil_instruction": ("key", "secret", "token", "密钥", "私钥", "密码", "口令", "凭据", "凭证", "credential", "环境变量", ".env"),
}


def _hinted(name: str, pattern: str) -> Column:
    """First match of an instruction's pattern, looked for only where one of its words is."""
    some = _holds(F.col("low"), _HINTS[name])
    if name in _NEEDED:
        some = some & _holds(F.col("low"), _NEEDED[name])
    return F.when(some, F.regexp_extract("text", pattern, 0)).otherwise("")


def _staged(rows: DataFrame) -> DataFrame:
    """``rows`` (row_id, text, request, ...) with what the parts look at, each cut or extracted once."""
    t = F.col("text")
    cut = rows.withColumns({"r": F.col("request"), "low": F.lower(t), "prose": T.prose(t), "code": T.code(t), "segments": F.filter(F.when(F.contains(t, F.lit("```")), F.split(t, T.FENCED, -1)).otherwise(F.array(t)), lambda s: s != "")})
    seen = {}
    for kind, pattern in P.ECHOES:
        bounded = rf"(?<![A-Za-z0-9_-]){pattern}" if kind == "slack_token" else pattern
        outside = F.transform(_seen(F.col("prose"), _MARKS.get(kind), bounded), lambda v: F.struct(v.alias("v"), F.lit(False).alias("in_code")))
        inside = F.transform(F.flatten(F.transform("code", lambda c: _seen(c, _MARKS.get(kind), bounded))), lambda v: F.struct(v.alias("v"), F.lit(True).alias("in_code")))  # noqa: B023
        mark = _MARKS[kind]
        none = F.array().cast("array<struct<v: string, in_code: boolean>>")
        seen[f"echo_{kind}"] = F.when(_holds(t, (mark,) if isinstance(mark, str) else mark), F.concat(outside, inside)).otherwise(none)
    urls = F.transform(_all(F.col("prose"), P.AUTO_FETCH), lambda m: F.coalesce(F.nullif(F.regexp_extract(m, P.AUTO_FETCH, 1), F.lit("")), F.regexp_extract(m, P.AUTO_FETCH, 2)))
    fetch = F.contains("low", F.lit("src")) | F.contains("text", F.lit("]("))
    seen |= {
        "marks": F.when(F.contains("text", F.lit("<|")) | F.contains("text", F.lit("INST]")) | F.contains("low", F.lit("sys>>")) | F.contains("low", F.lit("inst]")), _all(F.col("prose"), P.FAKE_TURN)).otherwise(F.array().cast("array<string>")),
        "leaking": F.when(fetch, F.filter(urls, lambda u: u.rlike(P.PAYLOAD))).otherwise(F.array().cast("array<string>")),
        "bidi": _all(t, P.BIDI),
        "zero": _all(t, P.ZERO_WIDTH),
        "heading": F.btrim(F.regexp_extract(F.coalesce(F.get("segments", F.lit(0)), F.lit("")), P.FAKE_HEADING, 0), F.lit(" \t\n\r\x0b\x0c")),
        "extraction": _hinted("prompt_extraction", P.PROMPT_EXTRACTION),
        "exfil": _hinted("credential_exfil_instruction", P.CREDENTIAL_EXFIL),
        "override": _hinted("instruction_override", P.OVERRIDE),
    }
    return cut.withColumns(seen)


def _poison_parts() -> list[Column]:
    """Of a staged table."""
    r = F.col("r")
    held = lambda v: F.coalesce(F.contains(r, v), F.lit(False))
    found: list[Column] = []
    signs: list[tuple[str, Column]] = []
    for name, seen, severity, least, note in (("bidi_override", F.col("bidi"), "HIGH", 1, " [双向覆盖符]"), ("hidden_unicode", F.col("zero"), "MEDIUM", P.ZERO_WIDTH_COUNT, " [零宽字符成规模出现]")):
        codes = F.array_join(F.transform(F.slice(seen, 1, 5), lambda c: F.concat(F.lit("U+"), F.upper(F.hex(F.encode(c, "UTF-16BE"))))), ",")
        found.append(_one(F.size(seen) >= least, _finding("response_poison", severity, "hidden_unicode", F.concat(F.lit("hidden_unicode: "), codes, F.lit(" (count="), F.size(seen).cast("string"), F.lit(f"){note}")))))
        signs.append((name, F.size(seen) >= least))
    shown = lambda u: F.concat(
        F.lit("exfil_url host="), F.regexp_extract(u, r"://([^/]*)", 1), F.lit(" len="), F.octet_length(u).cast("string"), F.lit(" sha256="), T.digest(u),
        F.lit(" [渲染即自动请求，query 载荷 "), F.octet_length(F.regexp_extract(u, P.PAYLOAD, 1)).cast("string"), F.lit(" 字符]"),
    )
    found.append(F.transform("leaking", lambda u: _finding("response_poison", "HIGH", "exfil_url", shown(u))))
    signs.append(("exfil_url", F.size("leaking") > 0))
    sample = lambda x: x["in_code"] | (F.length(x["v"]) < P.VALUE_CHARS) | T.ordered(x["v"]) | (T.entropy(x["v"]) <= P.VALUE_ENTROPY)
    for kind, _ in P.ECHOES:
        new = F.transform(F.filter(f"echo_{kind}", lambda x: ~held(x["v"])), lambda x: F.struct(x["v"].alias("v"), sample(x).alias("low")))
        level = lambda x: F.when(x["low"], "LOW").otherwise("MEDIUM")
        note = lambda x: F.when(x["low"], " [示例形态]").otherwise(" [疑似真实凭据]")
        found.append(F.transform(new, lambda x: _finding("response_poison", level(x), f"credential_echo:{kind}", F.concat(T.evidence(x["v"], F.lit(kind)), note(x)))))  # noqa: B023
    marks = F.col("marks")
    anchored = F.col("prose").rlike(r"(?im)^[ \t`'\"]*(?:" + P.FAKE_TURN.removeprefix("(?i)") + ")")
    fake = (F.size(marks) >= 2) & anchored & ~F.coalesce(F.forall(marks, lambda m: F.contains(r, m)), F.lit(False))
    turns = F.concat(F.lit("fake_system_block: "), F.array_join(F.array_sort(F.array_distinct(marks)), ","), F.lit(" (count="), F.size(marks).cast("string"), F.lit(") [伪造协议级系统轮次]"))
    found.append(_one(fake, _finding("response_poison", "MEDIUM", "fake_system_block", turns)))
    heading = F.col("heading")
    headed = (heading != "") & ~held(heading)
    found.append(_one(headed, _finding("response_poison", "MEDIUM", "fake_system_block", F.concat(F.lit("fake_system_block: "), T.without_credentials(heading), F.lit(" [正文出现伪系统标题]")))))
    signs.append(("fake_system_block", fake | headed))
    cut = lambda s: T.without_credentials(T.truncated(s, 80))
    for kind, column in (("prompt_extraction", "extraction"), ("credential_exfil_instruction", "exfil")):
        snippet = F.col(column)
        hit = (snippet != "") & ~held(snippet)
        found.append(_one(hit, _finding("response_poison", "MEDIUM", kind, F.concat(F.lit(f"{kind}: "), cut(snippet)))))
        signs.append((kind, hit))
    override = F.col("override")
    beside = F.array_compact(F.array(*[F.when(c, n) for n, c in signs]))
    named = F.concat(F.lit("instruction_override: "), cut(override), F.lit(" [同现载荷: "), F.array_join(beside, ","), F.lit("]"))
    found.append(_one((F.size(beside) > 0) & (override != "") & ~held(override), _finding("response_poison", "MEDIUM", "instruction_override", named)))
    some = (heading != "") | (F.col("extraction") != "") | (F.col("exfil") != "") | (override != "")
    for c in ("bidi", "zero", "leaking", "marks", *(f"echo_{k}" for k, _ in P.ECHOES)):
        some = some | (F.size(c) > 0)
    return _where(some, found)


def dangerous_action(rows: DataFrame) -> DataFrame:
    """Destructive commands: ``rows`` of row_id, text and request; of each kind the first pattern that hits. Always LOW.

    UPDATE counts if no WHERE follows within 400 characters before the next semicolon. What the request holds itself is no finding.
    """
    return _rows(rows.withColumn("low", F.lower("text")), _danger_parts(F.col("text"), F.col("low"), F.col("request")))


#: By pattern's name, words without which it can't hit, in lower case.
_DANGER_HINTS = {
    "递归删除根目录/家目录": ("rm",), "Windows 全盘删除": ("del", "erase"), "格式化磁盘": ("format",), "PowerShell 递归强删盘符": ("remove-item",), "dd 直写块设备": ("dd",), "格式化块设备": ("mkfs",), "删除数据库": ("drop",), "删除表": ("drop",), "清空表": ("truncate",),
    "DELETE 无 WHERE": ("delete",), "UPDATE 无 WHERE": ("update",), "kubectl 批量删除": ("kubectl",), "terraform destroy": ("terraform",), "删除 S3 桶": ("aws",), "curl 管道直接执行": ("curl",), "wget 管道直接执行": ("wget",), "fork 炸弹": (":()",),
}


#: By pattern's name, words of which a text must hold one as well.
_DANGER_NEEDS = {
    "递归删除根目录/家目录": ("-",), "Windows 全盘删除": ("/s", "/q"), "dd 直写块设备": ("of=/dev/",), "格式化块设备": ("/dev/",), "删除数据库": ("database", "schema"), "删除表": ("table",), "清空表": ("table",),
    "DELETE 无 WHERE": ("from",), "UPDATE 无 WHERE": ("set",), "删除 S3 桶": ("--force",), "curl 管道直接执行": ("|",), "wget 管道直接执行": ("|",),
}


def _danger_parts(t: Column, low: Column, r: Column) -> list[Column]:
    parts, done = [], {}
    for kind, name, pattern in P.DANGERS:
        whole = pattern + r"(?![^;]{0,395}?(?i:where))" if name.startswith("UPDATE") else pattern
        some = _holds(low, _DANGER_HINTS[name])
        if name in _DANGER_NEEDS:
            some = some & _holds(low, _DANGER_NEEDS[name])
        seen = F.when(some, _all(t, whole)).otherwise(F.array().cast("array<string>"))
        hits = F.filter(F.transform(seen, lambda v: F.btrim(v, F.lit(" \t\n\r\x0b\x0c"))), lambda v: ~F.coalesce(F.contains(r, v), F.lit(False)))
        first = F.get(hits, F.lit(0))
        shown = F.when(F.length(first) > P.SNIPPET, F.concat(F.substring(first, 1, P.SNIPPET - 3), F.lit("..."))).otherwise(first)
        done.setdefault(kind, []).append(F.when(F.size(hits) > 0, F.concat(F.lit(f"{name}: "), shown)))
    for kind, texts in done.items():
        evidence = F.coalesce(*texts)
        parts.append(_one(evidence.isNotNull(), _finding("dangerous_action", "LOW", kind, evidence)))
    return _where(_holds(low, tuple(sorted({w for words in _DANGER_HINTS.values() for w in words}))), parts)


SIGNALS = ("identity_swap", "response_poison", "error_leak", "sse_anomaly", "dangerous_action")


def response_hook(responses: DataFrame, enabled: bool = True, passive: bool = True, off: frozenset[str] = frozenset()) -> DataFrame:
    """All findings of whole responses in one pass: the signals that are on, with the command hits of the session among them.

    ``responses``: row_id, status, asked (the request's model), got (the response's), text (restored), request (null: unknown), headers,
    reasons (array: commands that the model only thought of) and hits (array of id, label, kind, snippet, blocked: commands found in
    channels). Errors are looked for from status 400 on; event streams of two events or more are checked for oddities; dangerous actions whose
    evidence holds one of ``reasons`` are left out; each command hit is a finding, HIGH if it was blocked, MEDIUM else. Nothing
    runs unless ``enabled`` and ``passive``. Equal findings of a row come once, with their number. A null array is an empty one.
    """
    on = [s for s in SIGNALS if s not in off] if enabled and passive else []
    text = F.coalesce("text", F.lit(""))
    staged = _staged(responses.withColumn("text", text))
    parts: list[Column] = [F.array().cast(FINDING)]
    if "identity_swap" in on:
        parts += _identity_parts(F.col("asked"), F.col("got"))
    if "response_poison" in on:
        parts += _poison_parts()
    if "error_leak" in on:
        whole = F.concat("text", F.lit("\n"), F.coalesce("headers", F.lit("")))
        parts.append(F.when(F.col("status") >= 400, F.concat(*[p.cast(FINDING) for p in _leak_parts(whole)])).otherwise(F.array().cast(FINDING)))
    if "sse_anomaly" in on:
        data = F.filter(frames.sse_data(F.col("text")), lambda x: F.try_parse_json(x).isNotNull())
        staged = staged.withColumn("_events", F.when(F.contains("text", F.lit("data:")), data).otherwise(F.array().cast("array<string>")))
        parts.append(F.when(F.size("_events") > 1, F.concat(*[p.cast(FINDING) for p in _stream_parts(F.col("_events"))])).otherwise(F.array().cast(FINDING)))
    if "dangerous_action" in on:
        danger = F.concat(*[p.cast(FINDING) for p in _danger_parts(F.col("text"), F.col("low"), F.col("r"))])
        reasons = F.filter(F.coalesce("reasons", F.array().cast("array<string>")), lambda x: x != "")
        parts.append(F.filter(danger, lambda f: ~F.exists(reasons, lambda x: F.contains(f["evidence"], x))))
        named = lambda h: F.concat_ws(" ", h["id"], F.nullif(h["label"], F.lit("")))
        told = lambda h: F.concat(F.lit("cmd_hit channel="), h["kind"], F.lit(" kind="), named(h), F.lit(" snippet="), T.truncated(h["snippet"], 120))
        hits = F.transform("hits", lambda h: _finding("dangerous_action", F.when(h["blocked"], "HIGH").otherwise("MEDIUM"), F.concat(F.lit("cmd_hit:"), named(h)), told(h)))
        parts.append(F.coalesce(hits.cast(FINDING), F.array().cast(FINDING)))
    return _rows(staged, parts)


def _stream_parts(events: Column) -> list[Column]:
    """Oddities of one row's events, as of ``stream_anomaly``."""
    js = lambda x, p: F.get_json_object(x, p)
    kind = lambda x: F.coalesce(js(x, "$.type"), F.lit(""))

    def unkeyed(x: Column) -> Column:
        out = F.lit(True)
        for k in P.STREAM_KEYS:
            out = out & js(x, f"$.{k}").isNull()
        return out

    delta = F.filter(events, lambda x: kind(x) == "message_delta")
    number = lambda found: F.filter(found, lambda n: n.isNotNull())
    out = number(F.transform(delta, lambda x: js(x, "$.usage.output_tokens").try_cast("long")))
    into = number(F.transform(delta, lambda x: js(x, "$.usage.input_tokens").try_cast("long")))
    starts = number(F.transform(F.filter(events, lambda x: kind(x) == "message_start"), lambda x: F.coalesce(js(x, "$.message.usage.input_tokens"), js(x, "$.usage.input_tokens")).try_cast("long")))
    unknown = F.transform(F.filter(events, lambda x: (kind(x) != "") & ~kind(x).isin(P.STREAM_EVENTS) & unkeyed(x)), kind)
    blanks = F.size(F.filter(delta, lambda x: F.coalesce(F.trim(js(x, "$.signature_delta")) == "", F.lit(False)))).cast("long")
    return _anomaly_parts(unknown, out, into, F.get(starts, F.size(starts) - 1), blanks)


def cross_request_pollution(rows: DataFrame, nonces: DataFrame) -> DataFrame:
    """Marks of earlier requests that recur: ``rows`` (row_id, text) that hold a ``nonce`` of ``nonces``, whole (see ``containment.occurrences``)."""
    met = containment.occurrences(rows, nonces, "nonce")
    return _rows(met, [F.array(_finding("cross_request_pollution", "HIGH", "prior_canary", F.concat(F.lit("prior_canary_recur: "), F.col("mark"))))])


def passive(findings: DataFrame) -> DataFrame:
    """Of each row its worst severity, findings by signal, and their number."""
    by = findings.groupBy("row_id", "signal").agg(F.max(severity_rank(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("row_id").agg(F.max("rank").alias("rank"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "n")))).alias("by_signal"), F.sum("n").alias("total"))


def recorded(findings: DataFrame, floor: str = "HIGH") -> DataFrame:
    """Findings from ``floor`` up, and dangerous actions in any case."""
    return findings.where((severity_rank(F.col("severity")) >= RANKS[floor]) | (F.col("signal") == "dangerous_action"))


def response_values(found: DataFrame, known: DataFrame, most: int = 10) -> DataFrame:
    """Sensitive values of responses (row_id, sid, label, value, ord) that the session's ``known`` (sid, value) doesn't hold, distinct, the first ``most`` of a row."""
    new = found.join(known.select("sid", "value").distinct(), ["sid", "value"], "left_anti")
    once = new.groupBy("row_id", "sid", "label", "value").agg(F.min("ord").alias("ord"))
    order = Window.partitionBy("row_id").orderBy("ord", "label", "value")
    return once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
