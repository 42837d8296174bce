"""What grows with the tables: work that is done once, by as many tasks as there are, and in bounded memory."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from sievemark.functions import json_spans
from sievemark.functions import masking as M
from sievemark.functions.transducers import Guard
from sievemark.operators import containment
from sievemark.operators.tables import sliced, spread
from sievemark.plans import flow_queries, stream_queries

SF = "/root/testdata/sf0.001"


def _passes(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") + plan.count("MapInPandas")


def test_pieces_are_guarded_once(spark):
    assert _passes(stream_queries.guarded(spark, SF)) == 1


def test_responses_are_restored_once(spark):
    assert _passes(stream_queries.whole_responses(spark, SF)) == 3  # masked, restored, taken apart


def test_streams_are_taken_apart_once(spark):
    assert _passes(flow_queries.streamed(spark, SF)) == 1


def test_small_rows_are_dealt_out(spark):
    one = spark.range(1000).coalesce(1)
    assert len({r.p for r in spread(one, "id").select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1


def test_cut_pieces_join_to_the_text(spark):
    texts = ["", "a", "x" * 37, "x" * 38, "中𝄞\r\n" * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", stream_queries._cut(F.col("text"), 37).alias("p")).collect()
    assert all("".join(r.p) == r.text and [len(p) for p in r.p[:-1]] == [37] * (len(r.p) - 1) and len(r.p[-1]) <= 37 for r in rows)


def test_stages_that_nothing_opens_are_passed_by():
    guard, states, searched = Guard(), [], []
    for stage in guard.stages:
        stage.feed = lambda *a, f=stage.feed, i=stage.id: searched.append(i) or f(*a)
    assert guard.feed(states, "now rm", False)[0] == "now"
    assert set(searched) < {s.id for s in guard.stages}


def test_texts_without_a_suffix_hold_no_placeholder():
    assert not M.may_hold('{"finish_reason": "stop", "x_y": "{{PHONE}}"}') and M.may_hold("{{ phone_BCDFGH }}")
    assert json_spans.restored('{"a":"{{PHONE\\u005fbcdfgh}}"}', {"bcdfgh": {"{{PHONE_bcdfgh}}": "1"}}).text == '{"a":"1"}'


def test_marks_ask_for_a_few_anchors(spark, monkeypatch):
    kept_rows, real = [], containment.kept
    monkeypatch.setattr(containment, "kept", lambda rows: kept_rows.append(real(rows)) or kept_rows[-1])
    mark = "".join(chr(97 + (i * i * 7 + i * 3) % 26) for i in range(3000))
    got = containment.occurrences(spark.createDataFrame([(1, "x" + mark), (2, mark[1:])], "row_id long, text string"), spark.createDataFrame([(mark,)], "mark string"))
    assert [(r.row_id, r.mark) for r in got.collect()] == [(1, mark)]
    held = next(r for r in kept_rows if set(r.columns) == {"row_id", "anchor"})
    assert held.count() <= 2 * containment.ASKED
    assert all("mark" not in r.columns or "anchor" not in r.columns for r in kept_rows)


def test_batches_come_in_slices_of_bounded_bytes():
    texts = ["x" * 400, None, "", "y" * 900, "z" * 5000, "中" * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["k", "text"])
    got = list(sliced([batch, batch.slice(0, 0)], 1, 1000))
    assert [b.column(0).to_pylist() for b in got] == [[0, 1, 2], [3], [4], [5], []]
    assert [t for b in got for t in b.column(1).to_pylist()] == texts
