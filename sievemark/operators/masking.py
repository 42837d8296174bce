"""Reversible masking of a corpus, and restoring it: all rules in one pass over the texts, tokens by a mapping table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blobs, json_spans
from ..functions import masking as M
from .tables import BROADCAST_ROWS, kept, sliced, written

#: What a masked row carries besides its text.
HITS = "array<struct<label: string, value: string, token: string>>"
MASKED = f"text string, hits {HITS}, warned long, warned_labels array<string>, blocked_labels array<string>"
_HIT = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string()), ("token", pa.string())]))


def _masked_body(masker: M.Masker, body: str, late: dict) -> tuple[M.Masked, str]:
    """A JSON body masked within its strings, numbers and keys, and what became of it.

    Embedded files are taken out before it is parsed and put back after; a token of theirs that is gone leaves the body as it was.
    """
    slim, files, _ = blobs.taken_out(body) if len(body) >= blobs.LEAST else (body, [], 0)
    if not json_spans.valid(slim):
        return M.Masked(body), "invalid"
    try:
        done = json_spans.masked(slim, masker, late)
    except json_spans.TooDeep:
        return M.Masked(body), "json_depth_exceeded"
    if files:
        whole = blobs.put_back(done.text, files)
        if whole is None:
            return M.Masked(body), "blob_lost"
        done.text = whole
    return done, "unchanged" if done.text == body else "masked"


def mask_bodies(bodies: DataFrame, settings: M.Settings = M.Settings(), key: str = "", mapping: DataFrame | None = None) -> DataFrame:
    """JSON ``bodies`` (text, ...) masked by spans: bytes of all that isn't masked stay as they are, repeated keys too.

    Columns as of ``mask``, and status: masked, unchanged, invalid (no JSON), json_depth_exceeded (over 24 levels) or blob_lost (an
    embedded file could not be put back); the last three keep their text, and it is up to the caller not to send it on. Exempt are protocol names, ids, settings and embedded
    files (see ``json_spans.exempt``); masked numbers become strings; JSON within tool arguments is masked inside.
    """
    return mask(bodies, settings, key, mapping, True)


def mask(corpus: DataFrame, settings: M.Settings = M.Settings(), key: str = "", mapping: DataFrame | None = None, json: bool = False) -> DataFrame:
    """``corpus`` with masked text, hits (label, value and token of all that was replaced), warned, warned_labels and blocked_labels.

    Steps in order: secret prefixes, dictionary, user patterns, then the rules of the table, each on the text that the ones
    before it left; candidates that touch a placeholder are no values. One pass over the texts, without a shuffle. Null
    texts stay null. Other columns are carried; those of the names above are replaced.

    Tokens depend on the key, the label and the value. ``mapping`` (as of ``tokens``) tells which values have another
    than their first token since another value has it; without one, two values may share a token with a probability of
    1 in 47 million a pair. Up to BROADCAST_ROWS such values are broadcast, more are joined to their texts.
    """
    kept_columns = [c for c in corpus.columns if c not in ("text", "hits", "warned", "warned_labels", "blocked_labels", *(["status"] if json else []))]
    rows = corpus.select(*kept_columns, "text")
    late = mapping.where("counter > 0").select("label", "value", "token") if mapping is not None else None
    shared = None
    if late is not None and (n := late.count()):
        if n <= BROADCAST_ROWS:
            shared = corpus.sparkSession.sparkContext.broadcast({(r.label, r.value): r.token for r in late.collect()})
        else:
            of_row = _late_of_rows(mask(corpus, settings, key, None, json), late)
            rows = rows.join(of_row, "row_id", "left")
    return _masked_rows(rows, kept_columns, settings, key, json, shared)


def _masked_rows(rows: DataFrame, kept_columns: list[str], settings: M.Settings, key: str, json: bool, shared: Broadcast | None = None) -> DataFrame:
    """What ``mask`` returns, of rows with the kept columns, text and, where none is shared, the late tokens of each row's values (``late``)."""
    own = "late" in rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept_columns), MASKED, *(["status string"] if json else [])])
    sent, name = rows.sparkSession.sparkContext.broadcast(settings), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = _masker(name, sent, key)
        known = shared.value if shared else {}
        for batch in sliced(batches, len(kept_columns)):
            texts = batch.column(len(kept_columns)).to_pylist()
            lates = batch.column(len(kept_columns) + 1).to_pylist() if own else None
            done, states = [], []
            for i, t in enumerate(texts):
                mine = {(x["label"], x["value"]): x["token"] for x in lates[i] or []} if own else known
                one, state = (M.Masked(t), "invalid") if not t else _masked_body(masker, t, mine) if json else (masker.run(t, mine), "")
                done.append(one)
                states.append(state)
            columns = [
                *batch.columns[: len(kept_columns)],
                pa.array([d.text for d in done], pa.string()),
                pa.array([[{"label": n, "value": v, "token": t} for (n, v), t in d.hits.items()] for d in done], _HIT),
                pa.array([d.warned for d in done], pa.int64()),
                pa.array([sorted(d.warned_labels) for d in done], pa.list_(pa.string())),
                pa.array([sorted(d.blocked_labels) for d in done], pa.list_(pa.string())),
                *([pa.array(states, pa.string())] if json else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept_columns, "text", "hits", "warned", "warned_labels", "blocked_labels", *(["status"] if json else [])])

    return rows.mapInArrow(run, schema)


_maskers: dict[str, M.Masker] = {}


def _masker(name: str, settings: Broadcast, key: str) -> M.Masker:
    """The masker of a call, built once for each worker: a dictionary may have hundreds of thousands of words."""
    if name not in _maskers:
        _maskers.clear()
        _maskers[name] = M.Masker(settings.value, key)
    return _maskers[name]


def _late_of_rows(masked: DataFrame, late: DataFrame) -> DataFrame:
    """row_id and the late tokens of the values that the row holds, of rows that hold any."""
    held = found(masked).select("row_id", "label", "value")
    return kept(held.join(late, ["label", "value"]).groupBy("row_id").agg(F.collect_set(F.struct("label", "value", "token")).alias("late")))


def mask_apart(corpus: DataFrame, settings: M.Settings = M.Settings(), key: str = "", json: bool = False, changed: bool = False) -> tuple[DataFrame, DataFrame]:
    """``corpus`` (row_id, text, ...) as ``mask`` masks it with the mapping of its own values, and that mapping.

    Texts are masked once and written, with the text that each was (``before``); only rows with a late value are masked
    again. ``changed``: only rows in which something was replaced.
    """
    first = mask(corpus.withColumn("before", F.col("text")), settings, key, None, json)
    hit = F.size("hits") > 0
    first = written(first.where(hit) if changed else first.withColumn("before", F.when(hit, F.col("before"))), "masked")
    mapping = tokens(found(first), key)
    late = mapping.where("counter > 0").select("label", "value", "token")
    before = F.when(hit, F.col("before")).otherwise(F.col("text"))  # where nothing was replaced, it is written once
    if not (n := late.count()):
        return first.withColumn("before", before), mapping
    of_row = _late_of_rows(first.where(hit), F.broadcast(late) if n <= BROADCAST_ROWS else late)
    of_row = F.broadcast(of_row) if of_row.count() <= BROADCAST_ROWS else of_row
    columns = [c for c in corpus.columns if c not in ("text", "hits", "warned", "warned_labels", "blocked_labels", "before", *(["status"] if json else []))] + ["before"]
    again = first.where(hit).join(of_row, "row_id").select(*columns, F.col("before").alias("text"), "late")
    out = first.where(hit).join(of_row, "row_id", "left_anti").select(first.columns).unionByName(_masked_rows(again, columns, settings, key, json))
    return (out if changed else out.unionByName(first.where(~hit))).withColumn("before", before), mapping


def found(masked: DataFrame) -> DataFrame:
    """row_id, label, value and token of each distinct value of each masked row."""
    return masked.select("row_id", F.explode("hits").alias("h")).select("row_id", "h.label", "h.value", "h.token")


#: Most times that values count on; only labels with nearly as many values as there are suffixes need so many.
ROUNDS = 200
#: Suffixes that a label's values can have.
SUFFIXES = len(M.CONSONANTS) ** 6
TOO_MANY = "a label has too many values for suffixes of six consonants"


def token(label, value, key: str, counter=0):
    """Placeholder of a value by one counter (a number or a column); ``tokens`` finds the counters that keep values apart."""
    count = F.lit(counter) if isinstance(counter, int) else counter
    digest = F.sha2(F.concat(F.lit(f"{key}|"), count.cast("string"), F.lit("|"), value), 256)
    letters = [F.substring(F.lit(M.CONSONANTS), (F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 19 + 1), F.lit(1)) for i in range(6)]
    plain = F.substring(F.regexp_replace(F.upper(label), "[^A-Z0-9]", ""), 1, 12)
    return F.concat(F.lit("{{"), F.when(plain == "", "TERM").otherwise(plain), F.lit("_"), *letters, F.lit("}}"))


def tokens(values: DataFrame, key: str) -> DataFrame:
    """label, value, token and counter of each distinct value of ``values`` (label, value).

    Of values that share a token the least keeps it; the others count on, as often as needed, and give way to values
    that have counted less. So every value has a token of its own, the same whenever the values are the same. Only
    values whose token is wanted twice, and those that they move to, take part in further rounds. A label with more
    values than there are suffixes is refused at once.
    """
    rows = values.select("label", "value").distinct().withColumn("counter", F.lit(0))
    rows = kept(rows.withColumn("token", token(F.col("label"), F.col("value"), key)))
    if (rows.groupBy(F.substring_index("token", "_", 1)).count().agg(F.max("count")).first()[0] or 0) > SUFFIXES:
        raise ValueError(TOO_MANY)
    late: DataFrame | None = None  # values that have counted on; all others are as in ``rows``
    wanted = kept(rows.groupBy("token").count().where("count > 1").select("token"))
    first = Window.partitionBy("token").orderBy("counter", "value")
    for _ in range(ROUNDS):
        if not (n := wanted.count()):
            break
        some = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
        held = rows.join(some, "token", "left_semi")
        if late is not None:
            held = held.join(late, ["label", "value"], "left_anti").select(late.columns).unionByName(late.join(some, "token", "left_semi").select(late.columns))
        moved = held.withColumn("place", F.row_number().over(first)).where("place > 1").withColumn("counter", F.col("counter") + 1)
        moved = kept(moved.select("label", "value", "counter", token(F.col("label"), F.col("value"), key, F.col("counter")).alias("token")))
        late = moved if late is None else kept(late.join(moved, ["label", "value"], "left_anti").select(moved.columns).unionByName(moved))
        wanted = kept(moved.select("token").distinct())  # no other token can have come to two values
    else:
        raise ValueError(TOO_MANY)
    rows = rows.select("label", "value", "counter", "token")
    return rows if late is None else kept(rows.join(late, ["label", "value"], "left_anti").select(rows.columns).unionByName(late))


RESTORED = "text string, restored long, degraded long, unresolved long, samples array<string>"


def restore_bodies(bodies: DataFrame, mapping: DataFrame) -> DataFrame:
    """JSON ``bodies`` (row_id, text, ...) with placeholders in strings and keys put back; columns as of ``restore``.

    Bytes of all else stay. Values of tool arguments are escaped for the JSON text that they stand in; a key keeps its placeholder where
    another key of its object has the restored name; encrypted content without a brace is skipped. What is no JSON is restored as text.
    """
    return restore(bodies, mapping, json=True)


def restore(masked: DataFrame, mapping: DataFrame, escape: bool = False, json: bool = False, each: Callable[..., M.Restored] | None = None, beside: str = "", own_hits: bool = False) -> DataFrame:
    """``masked`` (row_id, text, ...) with known placeholders of ``mapping`` (token, value) put back, and counts.

    Placeholders are known with white space or in other case within their braces, with escaped braces, and bare or half
    braced; degraded counts all but exact ones. Unknown ones stay and count as unresolved, bare ones only if the mapping has
    their suffix; samples holds the first five. ``escape``: values go into JSON strings. A boolean column ``known``
    (null: true) says whether the row's session is; where it isn't, nothing is restored and placeholders only count.
    Null texts stay null. A mapping of at most BROADCAST_ROWS tokens is broadcast, a larger one is joined to the suffixes that
    texts hold. Two values of one token are refused. ``each`` restores a text in a way of its own: it gets the text, the known tokens by
    suffix, whether the session is known, and the row's value of the column ``beside``. ``own_hits``: ``masked`` and ``mapping`` are of one
    ``mask_apart``, so the tokens in ``hits`` are the mapping's, and of those joined only suffixes that ``before`` held are looked up.
    """
    pairs = mapping.select("token", "value").distinct()
    sizes = pairs.groupBy("token").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    if (sizes["most"] or 0) > 1:
        raise ValueError("a token has two values")
    kept_columns = [c for c in masked.columns if c not in ("text", "restored", "degraded", "unresolved", "samples")]
    rows = masked.select(*kept_columns, "text")

    def one(t: str | None, known: dict, here: bool, other: str | None) -> M.Restored:
        if not t:
            return M.Restored(t)
        if each:
            return each(t, known, here, other)
        return json_spans.restored(t, known, here) if json and json_spans.valid(t) else M.restored(t, known, escape, here)

    shared, own = None, False
    if (sizes["n"] or 0) <= BROADCAST_ROWS:
        by_suffix: dict[str, dict[str, str]] = {}
        for r in pairs.collect():
            by_suffix.setdefault(r.token[-8:-2], {})[r.token] = r.value
        shared = masked.sparkSession.sparkContext.broadcast(by_suffix)
    elif own_hits:
        rows, own = _with_others(rows, pairs), True
    else:
        rows, own = _joined(rows, _known_of(_asked(rows, one, bool(each), json, beside), pairs)), True
    hits_at = kept_columns.index("hits") if own and own_hits else -1
    session = kept_columns.index("known") if "known" in kept_columns else -1
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept_columns), RESTORED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(kept_columns)):
            n = len(kept_columns)
            texts = batch.column(n).to_pylist()
            mine = batch.column(n + 1).to_pylist() if own else None
            sessions = batch.column(session).to_pylist() if session >= 0 else [True] * len(texts)
            hits = batch.column(hits_at).to_pylist() if hits_at >= 0 else None
            others = batch.column(kept_columns.index(beside)).to_pylist() if beside else [None] * len(texts)
            done = []
            for i, t in enumerate(texts):
                known = shared.value if shared else {}
                if own:
                    known = {}
                    for x in [*(hits[i] if hits else ()), *(mine[i] or [])]:
                        known.setdefault(x["token"][-8:-2], {})[x["token"]] = x["value"]
                done.append(one(t, known, sessions[i] is not False, others[i]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:n],
                    pa.array([d.text for d in done], pa.string()),
                    *[pa.array([getattr(d, c) for d in done], pa.int64()) for c in ("restored", "degraded", "unresolved")],
                    pa.array([d.samples for d in done], pa.list_(pa.string())),
                ],
                names=[*kept_columns, "text", "restored", "degraded", "unresolved", "samples"],
            )

    return rows.mapInArrow(run, schema)


def _suffixes(rows: DataFrame, text: str = "text") -> DataFrame:
    """row_id and each suffix that stands in the column ``text``, in lower case."""
    return rows.select("row_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_SUFFIXED), F.lit(0)), lambda s: F.lower(F.substring(s, 2, 6))))).alias("suffix"))


def _asked(rows: DataFrame, one: Callable[..., M.Restored], framed: bool, json: bool, beside: str) -> DataFrame:
    """row_id and each suffix that restoring a row's text looks for.

    Plain texts hold them as they are. JSON may write them with escapes, and events cut them into pieces; there it is the restoring itself that tells (``one``, with nothing known).
    """
    if not framed and not json:
        return _suffixes(rows)
    escaped = F.contains("text", F.lit("\\u"))
    columns = ["row_id", "text", *([beside] if beside else []), *(["known"] if "known" in rows.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            at, found = [], []
            texts = batch.column(1).to_pylist()
            others = batch.column(2).to_pylist() if beside else [None] * len(texts)
            sessions = batch.column(len(columns) - 1).to_pylist() if columns[-1] == "known" else [True] * len(texts)
            for i, t in enumerate(texts):
                if t and sessions[i] is not False:
                    asked = M.Asked()
                    one(t, asked, True, others[i])
                    suffixes = M.suffixes(t) | set(asked)
                    at += [i] * len(suffixes)
                    found += suffixes
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["row_id", "suffix"])

    told = (rows if framed else rows.where(escaped)).select(*columns).mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, suffix string")
    return told if framed else told.unionByName(_suffixes(rows.where(~escaped)))


def _known_of(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """row_id and all tokens of the suffixes of ``held`` (row_id, suffix)."""
    return held.join(pairs.withColumn("suffix", F.substring("token", -8, 6)), "suffix").groupBy("row_id").agg(F.collect_list(F.struct("token", "value")).alias("mine"))


def _joined(rows: DataFrame, of_row: DataFrame) -> DataFrame:
    return rows.join(of_row, "row_id", "left").select(*rows.columns, "mine")


_SUFFIXED = f"_(?i:{M.SUFFIX})"


def _with_others(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` (row_id, before, ...), those whose text held suffixes before it was masked with all tokens of these; the others meet no shuffle."""
    held = F.coalesce(F.contains("before", F.lit("_")) & F.regexp_like("before", F.lit(_SUFFIXED)), F.lit(False))
    of_row = kept(_known_of(_suffixes(rows.where(held), "before"), pairs))
    if of_row.count() <= BROADCAST_ROWS:
        return _joined(rows, F.broadcast(of_row))
    return _joined(rows.where(held), of_row).unionByName(rows.where(~held).withColumn("mine", F.lit(None).cast(of_row.schema["mine"].dataType)))


def round_trip(corpus: DataFrame, settings: M.Settings = M.Settings(), key: str = "", changed: bool = False) -> DataFrame:
    """``corpus`` (row_id, text) with before, masked, hits, restored text, and restored and unresolved counts: a test of settings on texts.

    ``changed``: only rows in which something was replaced.
    """
    masked, mapping = mask_apart(corpus, settings, key, changed=changed)
    back = restore(masked.withColumn("masked", F.col("text")), mapping, own_hits=True)
    return back.select("row_id", "before", "masked", "hits", F.col("text").alias("restored_text"), "restored", "unresolved")
