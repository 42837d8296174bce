"""Columns over texts: truncation by bytes, entropy, previews, escapes, code fences, evidence."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .masking import PLACEHOLDER
from .patterns import ECHOES, ORDERED, SECRETS

#: Fenced code: from the line of a fence to that of the next one, or to the end.
FENCED = r"(?ms)^[^\S\n]*```.*?^[^\S\n]*```[^\n]*|^[^\S\n]*```.*\z"


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a column that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truncated(text: Column, most: int) -> Column:
    """The longest start of ``text`` of at most ``most`` bytes that cuts no character."""
    # bytes as they are, which copies no more than is kept; encoded anew only where they are no valid text
    both = (text.cast("binary"), F.encode(text, "utf-8"))
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, max(0, most - k)).cast("string")) for data in both for k in range(4)])
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def last_bytes(text: Column, most: int) -> Column:
    """The end of ``text`` of ``most`` bytes, or up to three more that finish a character."""
    data, n = F.encode(text, "utf-8"), F.octet_length(text)
    cut = [F.try_validate_utf8(F.substring(data, n - most + 1 - k, F.lit(most + k)).cast("string")) for k in range(4)]
    return F.when(n <= most, text).otherwise(F.coalesce(*cut))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text. Characters are counted by taking them out one after another, so what is left to look through gets short."""
    n, chars = F.length(text), F.array_distinct(F.filter(F.split(text, "", -1), lambda c: c != ""))

    def without(acc: Column, c: Column) -> Column:
        p = lambda rest: (F.octet_length(acc["rest"]) - F.octet_length(rest)) / F.octet_length(c) / acc["n"]
        part = lambda rest: named(p(rest), lambda x: x * F.log2(x))
        return named(F.replace(acc["rest"], c, F.lit("")), lambda rest: F.struct(rest.alias("rest"), acc["n"].alias("n"), (acc["bits"] - part(rest)).alias("bits")))

    start = F.struct(text.alias("rest"), n.alias("n"), F.lit(0.0).alias("bits"))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(chars, start, without, lambda acc: acc["bits"]))


def ordered(text: Column) -> Column:
    """Whether the text holds the whole alphabet or all digits in order, either way."""
    found = F.lit(False)
    for s in ORDERED:
        found = found | F.contains(F.lower(text), F.lit(s))
    return found


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def evidence(text: Column, kind: Column) -> Column:
    return F.concat(kind, F.lit(" len="), F.length(text).cast("string"), F.lit(" sha256="), digest(text))


def without_credentials(text: Column) -> Column:
    """``text`` with each credential shape replaced by its name."""
    for kind, pattern in [*((k, p) for k, _, p in SECRETS), *ECHOES]:
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    return text


def prose(text: Column) -> Column:
    """``text`` with a line break in the place of each fenced stretch."""
    return F.when(F.contains(text, F.lit("```")), F.regexp_replace(text, FENCED, "\n")).otherwise(text)


def code(text: Column) -> Column:
    """Fenced stretches."""
    return F.when(F.contains(text, F.lit("```")), F.regexp_extract_all(text, F.lit(FENCED), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def json_escaped(text: Column) -> Column:
    """``text`` as it stands within a JSON string, other than ASCII kept."""
    return F.when(text.isNull(), "").otherwise(named(F.to_json(F.struct(text.alias("v"))), lambda j: F.substr(j, F.lit(len('{"v":"') + 1), F.length(j) - len('{"v":""}'))))


def json_unescaped(text: Column) -> Column:
    r"""``\"``, ``\\``, ``\n`` and ``\t`` undone, from left to right; other backslashes stay."""
    parts = F.split(text, r"\\\\", -1)
    plain = lambda p: F.replace(F.replace(F.replace(p, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return F.array_join(F.transform(parts, plain), "\\")


def preview(text: Column) -> Column:
    """Of a value: nothing, first and one star, first and stars, first and last, or two at both ends, by its length."""
    n = F.length(text)
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    return (
        F.when(n == 0, "").when(n <= 2, F.concat(first, F.lit("*"))).when(n <= 5, F.concat(first, F.repeat(F.lit("*"), n - 1)))
        .when(n <= 12, F.concat(first, F.repeat(F.lit("*"), n - 2), last)).otherwise(F.concat(F.substring(text, 1, 2), F.lit("**"), F.substring(text, -2, 2)))
    )


def credential_preview(text: Column, label: Column) -> Column:
    """Of a credential: the kind of a private key, both ends of a long random one, else label and length."""
    n = F.length(text)
    kind = F.lit("PEM")
    for name in ("PGP", "DSA", "OPENSSH", "EC", "RSA"):
        kind = F.when(F.contains(text, F.lit(f"{name} PRIVATE KEY")), name).otherwise(kind)
    ends = F.concat(F.substring(text, 1, 4), F.lit("…"), F.substring(text, -4, 4))
    return (
        F.when(label == "PRIVATE_KEY", F.concat(F.lit("<"), kind, F.lit(" 私钥 "), n.cast("string"), F.lit(" 字节>")))
        .when(label.isin("API_KEY", "TOKEN", "ACCESS_KEY", "JWT") & (n >= 20), ends)
        .otherwise(F.concat(F.lit("<"), label, F.lit(" "), n.cast("string"), F.lit(" 位>")))
    )


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first character in which the texts differ; -1 for equal ones. Nothing beyond the shorter one's end is taken apart."""
    most = F.least(F.length(a), F.length(b)) + 1
    pairs = F.arrays_zip(F.split(F.substr(a, F.lit(1), most), "", -1).alias("p"), F.split(F.substr(b, F.lit(1), most), "", -1).alias("q"))
    at = F.array_position(F.transform(pairs, lambda x: ~x["p"].eqNullSafe(x["q"])), F.lit(True))
    return F.when(a == b, F.lit(-1).cast("long")).otherwise(at - 1)


def human_bytes(n: Column) -> Column:
    """``1.0 MiB`` or ``512 KiB``."""
    return F.when(n >= 1 << 20, F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit(" MiB"))).otherwise(F.concat(F.floor(n / 1024).cast("string"), F.lit(" KiB")))


def utc(seconds: Column) -> Column:
    """``2024-01-01 00:00:00 UTC`` of seconds since 1970."""
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def split_words(text: Column) -> Column:
    """Words of a pasted list, between line breaks, commas, semicolons and white space; each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[\n\r,，、;；\s]+", -1), lambda w: F.trim(w)), lambda w: w != ""))


def safe_label(label: Column) -> Column:
    plain = F.substring(F.regexp_replace(F.upper(label), "[^A-Z0-9]", ""), 1, 12)
    return F.when(plain == "", "TERM").otherwise(plain)



def derived(text: Column, items: Column) -> Column:
    """``text`` with the original of each item (array of original and token) replaced by its token, the longest first."""
    order = F.array_sort(F.transform(items, lambda x: F.struct((-F.length(x["original"])).alias("n"), x["original"].alias("o"), x["token"].alias("t"))))
    return F.aggregate(order, text, lambda acc, x: F.when(x["o"] == "", acc).otherwise(F.replace(acc, x["o"], x["t"])))


def marked(text: Column, needles: Column) -> Column:
    """start, end and kind (placeholder or value) of what a display shows: placeholders first, then the longest needles, none overlapping."""

    @F.arrow_udf("array<struct<start: int, end: int, kind: string>>")
    def run(texts: pa.Array, all_needles: pa.Array) -> pa.Array:
        at, starts, ends, kinds = array("i", [0]), array("i"), array("i"), array("b")
        absent = []
        for t, s in zip(texts, all_needles):
            text = t.as_py()
            absent.append(text is None)
            for a, b, kind in [] if text is None else _marks(text, [n for n in s.as_py() or [] if n]):
                starts.append(a)
                ends.append(b)
                kinds.append(kind)
            at.append(len(starts))
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(KINDS).take(pa.array(kinds, pa.int8()))], ["start", "end", "kind"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans, mask=pa.array(absent, pa.bool_()))

    return run(text, needles)


KINDS = ["placeholder", "value"]


def _marks(text: str, needles: list[str]) -> list[tuple[int, int, int]]:
    """start, end and number of the kind of each span, in order; what is taken is marked by character."""
    found, taken = [], bytearray(len(text))
    for kind, pattern in [(0, PLACEHOLDER), *((1, re.escape(n)) for n in sorted(set(needles), key=lambda n: (-len(n), n)))]:
        for m in re.finditer(pattern, text):
            a, b = m.span()
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                found.append((a, b, kind))
    return sorted(found)


def target(url: Column) -> Column:
    """scheme, host, port and path prefix of an upstream's address; null for one without a scheme or a host.

    The port is the scheme's unless a valid one is given; what follows a colon and is no port belongs to the host.
    Addresses of six parts stand in brackets. The path loses the slashes at its end.
    """
    t = F.trim(url)
    scheme = F.regexp_extract(t, r"\A(https?)://", 1)
    rest = F.substr(t, F.length(scheme) + F.lit(4))
    authority = F.regexp_extract(rest, r"\A([^/]*)", 1)
    path = F.substr(rest, F.length(authority) + F.lit(1))
    closed = F.regexp_extract(authority, r"\A\[([^\]]*)\]", 1)
    six = F.startswith(authority, F.lit("["))
    after = F.when(six, F.regexp_extract(authority, r"\]:(\+?[0-9]+)\z", 1)).otherwise(F.regexp_extract(authority, r":(\+?[0-9]+)\z", 1))
    port = F.when((after != "") & (after.try_cast("bigint") <= 65535), after.try_cast("int"))
    plain = F.when(port.isNotNull(), F.regexp_replace(authority, r":\+?[0-9]+\z", "")).otherwise(authority)
    host = F.when(six, closed).otherwise(plain)
    usual = F.when(scheme == "https", 443).otherwise(80)
    parts = F.struct(scheme.alias("scheme"), host.alias("host"), F.coalesce(port, usual).alias("port"), F.regexp_replace(path, r"/+\z", "").alias("path_prefix"))
    return F.when((scheme != "") & (host != ""), parts)
