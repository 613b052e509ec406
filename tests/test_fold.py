import random

import pytest

from spanloom.operators import fold as fo
from spanloom.schema import SCALARS

from .helpers import events, one
from .model import fold as model


def test_logs_duration_and_count(spark):
    e = events(spark, [
        {"trace_id": 1, "span_id": 10, "seq": 1, "event_type": 1, "status": 0, "logs": ["开始"]},
        {"trace_id": 1, "span_id": 10, "seq": 2, "event_type": 2, "duration_ns": 500, "logs": ["结束"]},
    ])
    r = one(fo.fold(e))
    assert (r.status, r.duration_ns, r.logs, r.event_count) == (0, 500, ["开始", "结束"], 2)


@pytest.mark.parametrize(
    ("rows", "status"),
    [
        ([{"seq": 5, "status": 2}, {"seq": 1, "status": 0}], 2),
        ([{"seq": 1, "status": 7}, {"seq": 2, "status": None}], 7),
    ],
)
def test_last_value_in_sequence_order(spark, rows, status):
    assert one(fo.fold(events(spark, [{"trace_id": 1, "span_id": 1, **r} for r in rows]))).status == status


def test_retries_count_once(spark):
    a = {"trace_id": 1, "span_id": 1, "seq": 1, "status": 0, "duration_ns": 100, "logs": ["x"]}
    r = one(fo.fold(events(spark, [a, a, {"trace_id": 1, "span_id": 1, "seq": 2, "status": 1, "logs": ["x", "y"]}])))
    assert (r.event_count, r.logs, r.status, r.duration_ns) == (2, ["x", "y"], 1, 100)


def test_order_of_output(spark):
    e = events(spark, [{"trace_id": t, "span_id": s} for t, s in ((2, 1), (1, 9), (1, 2))])
    assert [(r.trace_id, r.span_id) for r in fo.fold(e, sort=True).collect()] == [(1, 2), (1, 9), (2, 1)]


def test_lifecycle(spark):
    rows = [
        {"trace_id": 1, "span_id": 1, "event_type": 1},
        {"trace_id": 1, "span_id": 2, "event_type": 1}, {"trace_id": 1, "span_id": 2, "event_type": 2, "seq": 2},
        {"trace_id": 1, "span_id": 3, "event_type": 2}, {"trace_id": 1, "span_id": 4, "event_type": 4},
    ]
    got = {r.span_id: (r.l, r.s) for r in fo.fold(events(spark, rows)).select("span_id", fo.lifecycle().alias("l"), fo.status_label().alias("s")).collect()}
    assert got == {1: ("running", "run"), 2: ("completed", "ok"), 3: ("orphan_end", "incomplete"), 4: ("incomplete", "incomplete")}


def test_a_reused_identity_in_another_trace_is_lost(spark):
    e = events(spark, [{"trace_id": 1, "span_id": 1, "ext_span_id": "x"}, {"trace_id": 2, "span_id": 1, "ext_span_id": "x"}])
    assert [r.trace_id for r in fo.fold(e).collect()] == [1]


def test_patches_and_deletes(spark):
    e = events(spark, [{"trace_id": 1, "span_id": 1, "model": "a", "logs": ["l"], "attrs": {"k": "1", "j": "2"}}])
    patch = spark.createDataFrame(
        [(1, 1, 1, "b", None, ["m"], {"k": "3"}), (1, 1, 2, "c", 700, ["l"], None)],
        "trace_id long, span_id long, segment_id int, model string, eval_score int, logs array<string>, attrs map<string,string>",
    )
    r = one(fo.fold(e, patch))
    assert (r.model, r.eval_score, r.logs, r.attrs) == ("c", 700, ["l", "m"], {"k": "3", "j": "2"})
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "segment_id long, row_id long, v string")
    gone = spark.createDataFrame([(1, 2)], "segment_id long, row_id long")
    assert [x.v for x in fo.delete_rows(rows, gone).collect()] == ["a"]


@pytest.mark.parametrize("seed", range(3))
def test_random_events_against_the_model(spark, seed):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice([None, *v])
    rows = []
    for _ in range(300):
        t, s = rnd.randint(1, 4), rnd.randint(1, 5)
        rows.append({
            "trace_id": t, "span_id": s, "seq": rnd.randint(1, 6), "event_type": rnd.randint(1, 5), "status": pick(0, 1, 2), "duration_ns": pick(5, 9),
            "model": pick("m", "n"), "agent_name": pick("a"), "input_text": pick("in", ""), "logs": pick(["p"], ["q", "p"], []), "attrs": pick({"a": "1"}, {"a": "2", "b": "3"}),
        })
        if rnd.random() < 0.2:
            rows.append(rows[-1])
    want = model([r | {"_arrival": n, "ext_span_id": f"{r['trace_id']}-{r['span_id']}"} for n, r in enumerate(rows)])
    got = {(r.trace_id, r.span_id): r.asDict() for r in fo.fold(events(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c in (*SCALARS, "logs", "event_count", "has_start", "has_end"):
            assert got[k][c] == w[c], (k, c)
        assert dict(got[k]["attrs"] or {}) == w["attrs"]
