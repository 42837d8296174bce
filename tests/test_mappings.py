"""The mapping table: seeding, merging, versions, and lookups by value, token and suffix; addresses, embedded files, items."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from sievemark.functions import texts as T
from sievemark.functions.masking import Settings
from sievemark.operators import mapping_store as store
from sievemark.operators import masking, requests

AT = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"]


def seed(spark, now, words, at):
    return store.seed_words(now, spark.createDataFrame(words, "word string, label string"), "k", F.lit(at))


def rows(df, *columns):
    return sorted((tuple(str(v) for v in r) for r in (df.select(*columns) if columns else df).collect()))


def test_seeding_twice_equals_once_and_follows_changes(spark):
    empty = spark.createDataFrame([], store.MAPPING)
    words = [("Acme", "Firm"), ("Bolt", "Firm"), ("Core", "x y"), ("", "Firm"), (None, "Firm"), ("Acme", "Firm")]
    once = seed(spark, empty, words, AT[0])
    assert rows(seed(spark, once, words, AT[0])) == rows(once)
    twice = seed(spark, once, words, AT[1])
    assert rows(twice, "value", "label", "token", "custom", "created") == rows(once, "value", "label", "token", "custom", "created") and {str(r.touched) for r in twice.collect()} == {AT[1]}
    changed = {r.value: r for r in seed(spark, twice, [("Acme", "FIRM"), ("Core", "Other")], AT[2]).collect()}
    before = {r.value: r for r in once.collect()}
    assert set(changed) == {"Acme", "Core"} and set(before) == {"Acme", "Bolt", "Core"}
    assert changed["Acme"].token == before["Acme"].token and changed["Acme"].label == "FIRM" and str(changed["Acme"].created) == AT[0]
    assert changed["Core"].token.startswith("{{OTHER_") and before["Core"].token.startswith("{{XY_") and str(changed["Core"].created) == AT[2]


def test_new_words_keep_off_suffixes_in_use(spark):
    wanted = {w: masking.token(F.lit("W"), F.lit(w), "k", 0) for w in ("one", "two")}
    tokens = spark.range(1).select(*[c.alias(w) for w, c in wanted.items()]).first()
    found = spark.createDataFrame([("other", "W", tokens["one"], False), ("else", "Z", "{{Z_" + tokens["two"][-8:-2] + "}}", False)], "value string, label string, token string, custom boolean")
    found = found.withColumn("created", F.lit(AT[0]).cast("timestamp")).withColumn("touched", F.col("created"))
    got = {r.value: r.token for r in seed(spark, found, [("one", "W"), ("two", "W"), ("three", "W")], AT[1]).collect()}
    assert set(got) == {"one", "two", "three", "other", "else"}
    assert len({t[-8:-2] for t in got.values()}) == 5
    assert got["one"] == spark.range(1).select(masking.token(F.lit("W"), F.lit("one"), "k", 1)).first()[0]


def test_words_that_want_one_suffix_count_on(spark, monkeypatch):
    monkeypatch.setattr(store, "token", lambda label, value, key, counter=0: F.concat(F.lit("{{W_"), F.rpad(F.concat(F.lit("b"), F.substring(F.translate(counter.cast("string"), "0123456789", "bcdfghjkmn"), 1, 5)), 6, "z"), F.lit("}}")))
    got = seed(spark, spark.createDataFrame([], store.MAPPING), [(f"w{i}", "W") for i in range(6)], AT[0]).orderBy("value").collect()
    assert len({r.token for r in got}) == 6 and [r.token for r in got] == sorted(r.token for r in got)


def test_merges_in_any_order_and_again_are_alike(spark):
    rng = random.Random(6)
    uses = [(f"v{i % 7}", rng.choice("ab"), f"t{i % 7}", False, AT[rng.randint(0, 2)][:17] + f"{i % 60:02d}") for i in range(50)] + [("x", "a", None, False, AT[0]), ("x", "a", "t", False, None)]
    df = spark.createDataFrame(uses, "value string, label string, token string, custom boolean, ts string").withColumn("n", F.monotonically_increasing_id() % 3)
    empty = spark.createDataFrame([], store.MAPPING)
    whole = store.upsert(empty, df)
    for order in ((0, 1, 2), (2, 0, 1, 0)):
        now = empty
        for k in order:
            now = store.upsert(now, df.where(F.col("n") == k))
        assert rows(now) == rows(whole)
    assert rows(store.upsert(whole, df)) == rows(whole) and whole.count() == 7


def test_versions_and_retries(spark, tmp_path):
    table = store.Versions(spark, str(tmp_path / "m"), store.MAPPING)
    assert table.read().count() == 0 and table.list() == []
    words = spark.createDataFrame([("Acme", "Firm")], "word string, label string")
    make = lambda now: store.seed_words(now, words, "k", F.lit(AT[0]))
    assert [table.commit("b1", make) for _ in range(3)] == [1, 1, 1] and table.list() == [(1, "b1")]
    with pytest.raises(ZeroDivisionError):
        table.commit("b2", lambda now: 1 / 0)
    (tmp_path / "m" / "_draft-b2").mkdir()  # what a writer that died left behind
    assert table.commit("b2", lambda now: store.seed_words(now, words.limit(0), "k", F.lit(AT[1]))) == 2
    assert table.read().count() == 0 and table.read(1).count() == 1
    table.keep_last(1)
    assert table.list() == [(2, "b2")]
    with pytest.raises(ValueError):
        table.commit("a/b", make)


def test_lookups(spark):
    m = spark.createDataFrame([("v", "L", "{{L_bbbbbb}}", False), ("v", "W", "{{W_cccccc}}", True), ("{{L_bbbbbb}}", "N", "{{N_dddddd}}", False), ("q", "L", "{{L_gggggg}}", False), ("r", "M", "{{M_gggggg}}", False)], "value string, label string, token string, custom boolean")
    m = m.withColumn("created", F.lit(AT[0]).cast("timestamp")).withColumn("touched", F.col("created"))
    values = spark.createDataFrame([("L", "v"), ("L", "none"), ("L", "{{L_zzzzzz}}"), ("L", None)], "label string, value string")
    assert {(r.value, r.token) for r in store.lookup(values, m).collect()} == {("v", "{{W_cccccc}}"), ("none", None), ("{{L_zzzzzz}}", "{{L_zzzzzz}}"), (None, None)}
    assert {(r.token, r.value) for r in store.originals(m.select("token"), m).collect()} == {(r.token, r.value) for r in m.collect()}
    assert {(r.token, r.value) for r in store.unwrapped(m).collect()} == {("{{L_bbbbbb}}", "v"), ("{{W_cccccc}}", "v"), ("{{N_dddddd}}", "v"), ("{{L_gggggg}}", "q"), ("{{M_gggggg}}", "r")}
    bare = spark.createDataFrame([("l", "bbbbbb"), ("X", "bbbbbb"), ("L", "gggggg"), ("L", "zzzzzz"), (None, "bbbbbb")], "label string, suffix string")
    assert {(r.label, r.suffix, r.token) for r in store.by_suffix(bare, m).collect()} == {("l", "bbbbbb", "{{L_bbbbbb}}"), ("X", "bbbbbb", None), ("L", "gggggg", None), ("L", "zzzzzz", None), (None, "bbbbbb", None)}


def test_nesting_ends_after_five_levels_and_in_cycles(spark):
    letters = "bcdfghjk"
    name = lambda i: "{{N_" + letters[i] * 6 + "}}"
    chain = [(name(0), "plain")] + [(name(i), name(i - 1)) for i in range(1, 8)] + [("{{C_bbbbbb}}", "{{C_cccccc}}"), ("{{C_cccccc}}", "{{C_bbbbbb}}"), ("{{D_bbbbbb}}", "{{D_zzzzzz}}")]
    got = {r.token: r.value for r in store.unwrapped(spark.createDataFrame(chain, "token string, value string")).collect()}
    assert all(got[name(i)] == "plain" for i in range(6)) and got[name(6)] == name(0) and got[name(7)] == name(1)
    assert got["{{D_bbbbbb}}"] == "{{D_zzzzzz}}" and len(got) == len(chain)


@pytest.mark.parametrize("url,want", [
    ("https://a.b", ("https", "a.b", 443, "")), (" http://a.b:8080/x/y// ", ("http", "a.b", 8080, "/x/y")), ("https://[::1]:9/", ("https", "::1", 9, "")), ("https://[::1]", ("https", "::1", 443, "")), ("http://h:99999/p", ("http", "h:99999", 80, "/p")),
    ("ftp://a", None), ("a.b", None), ("", None), (None, None), ("https:///x", None), ("https://[::1/x", None), ("http://h:/", ("http", "h:", 80, "")),
])
def test_targets(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(T.target(F.col("u")).alias("t")).first().t
    assert (tuple(got) if got else None) == want


def test_embedded_files_pass_byte_by_byte(spark):
    data = "data:image/png;base64," + base64.b64encode(random.Random(1).randbytes(3000)).decode()
    long = base64.b64encode(random.Random(2).randbytes(9000)).decode()
    bodies = [("a", json.dumps({"input": {"content": "13812345678", "image": data}})), ("b", json.dumps({"input": [data, data, long, "13812345678"]})), ("c", '{"input": "' + data), ("d", json.dumps({"input": {data: "13812345678"}}))]
    got = {r.row_id: r for r in masking.mask_bodies(spark.createDataFrame(bodies, "row_id string, text string"), Settings(), "k").collect()}
    assert json.loads(got["a"].text)["input"]["image"] == data and "13812345678" not in got["a"].text
    assert json.loads(got["b"].text)["input"][:3] == [data, data, long] and got["b"].status == "masked"
    assert got["c"].status == "invalid" and got["c"].text == bodies[2][1]


def test_restore_items(spark):
    mapping = spark.createDataFrame([("s", "EMAIL", f"v{i:03d}", f"t{i}") for i in range(40)] + [("s", "A", "v000", "t0"), ("u", "API_KEY", "secret", "k"), ("u", "EMAIL", "", "e"), ("u", "EMAIL", None, "e")], "sid string, label string, value string, token string")
    restored = spark.createDataFrame([("s", "t3"), ("s", "t3"), ("u", "t3"), ("u", "k")], "sid string, token string")
    got = requests.restore_items(mapping, restored).orderBy("sid", "ord").collect()
    assert [r.original for r in got if r.sid == "s"] == [f"v{i:03d}" for i in range(30)] and [r.token for r in got if r.restored] == ["t3", "k"]
    assert got[0].label == "A" and [(r.original, r.restored) for r in got if r.sid == "u"] == [(None, True)]
