import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators.evaluate import keyword_score
from spanloom.store import TraceStore


def wire(trace, span, seq, kind, **more):
    return {"trace_id": trace, "span_id": span, "ts": seq, "seq": seq, "event_type": kind, "ext_span_id": f"{trace}-{span}", **more}


BATCH = [
    wire(1, 1, 1, 1, session_id=7, agent_name="planner", input_text="refund review", attrs={"loop_id": "L", "task_fingerprint": "t"}),
    wire(1, 1, 2, 2, status=0, duration_ns=5, output_text="all clear"),
    wire(1, 2, 1, 2, session_id=7, tool_name="sql", parent_span_id=1, status=0, duration_ns=9),
    wire(2, 1, 1, 2, session_id=7, agent_name="planner", status=1, input_text="refund refund", output_text="cannot help", attrs={"loop_id": "L"}),
]


@pytest.fixture
def store(spark, tmp_path):
    found = TraceStore(spark, str(tmp_path / "store"), tenant_id=1)
    found.batch = found.ingest(json.dumps(BATCH))
    TraceStore(spark, found.folder, tenant_id=2).ingest(json.dumps([wire(9, 1, 1, 1, input_text="refund")]))
    return found


def ids(df):
    return [r.trace_id for r in df.collect()]


def test_reads(store):
    assert sorted(ids(store.traces())) == [1, 2]  # the other tenant's trace is hidden
    assert [(r.session_id, r.trace_count) for r in store.sessions().collect()] == [(7, 2)]
    assert [r.turn for r in store.session(7).orderBy("turn").collect()] == [0, 1]
    assert [(r.trace_id, r.total) for r in store.trace_search({"agent": "planner", "status": 1}).collect()] == [(2, 1)]
    assert store.trace_search({"traceId": "1"}).count() == 2
    assert [(r.key_0, r.span_count) for r in store.trace_aggregate(["tool"]).collect()] == [("null", 2), ('"sql"', 1)]
    assert store.storage_stats().first().event_count == 4
    assert store.span(1, 1).first().output_text == "all clear" and store.trace(1).count() == 2
    assert [r.span_count for r in store.trace_diff(1, 2).select(F.col("delta_span_count").alias("span_count")).collect()] == [-1]
    assert [(r.loop, r.trace_count) for r in store.loops().collect()] == [("L", 2)]
    summary, paths, own = store.loop("L")
    assert (summary.count(), paths.count(), own.count()) == (1, 2, 2)
    assert ids(store.task_traces("t")) == [1]
    assert store.trajectory_groups().count() == 2
    nodes, edges = store.agent_graph()
    assert nodes.count() == 3 and edges.count() == 1  # of each trace


def test_search(store, spark):
    assert sorted(ids(store.search({"text": "refund"}))) == [1, 2]
    assert ids(store.search({"text": "refund", "status": 1})) == [2]
    store.add_vectors(spark.createDataFrame([(1, 1, [0.0, 0.0]), (2, 1, [3.0, 0.0]), (9, 1, [0.0, 0.0])], "trace_id long, span_id long, embedding array<float>"))
    store.add_vectors(spark.createDataFrame([(1, 1, [9.0, 0.0])], "trace_id long, span_id long, embedding array<float>"))
    assert ids(store.search({"vector": [0.0, 0.0]}, k=1)) == [2]
    assert sorted(ids(store.search({"text": "review", "vector": [0.0, 0.0]}))) == [1, 2]
    with pytest.raises(ValueError):
        store.search({"text": "x", "mode": "semantic"})


def test_scores(store):
    overall = store.write_scores(keyword_score(["cannot"])).where("agent_name is null").first()
    assert (overall.scored, overall.passed) == (2, 1)
    assert store.span(2, 1).first().eval_score is not None


def test_metadata_and_retention(store, spark):
    store.annotate(spark.createDataFrame([(5, 1, "bad")], "id long, trace_id long, label string"))
    store.associate(spark.createDataFrame([], "id long, trace_id long, dataset_id string"))
    assert ids(store.annotations(label="bad")) == [1] and store.associations().count() == 0
    assert {r.trace_id: (r.reasons, r.deletable) for r in store.retention_plan().collect()} == {1: ("annotation", False), 2: ("", True)}
    store.delete_annotations(spark.createDataFrame([(5,)], "id long"))
    assert store.annotations().count() == 0 and store.annotations(include_deleted=True).count() == 1
    store.ingest(json.dumps([wire(1, 3, 1, 1)]))  # now trace 1 has rows after the batch
    assert ids(store.retention_apply(store.batch)) == [1]
    assert ids(store.traces()) == [1]
    audit = store.retention_audit().first()
    assert (audit.deleted_traces, audit.sample_ids) == (1, [2])
    store.ingest(json.dumps([wire(2, 1, 1, 2)]))  # a trace may come back
    assert sorted(ids(store.traces())) == [1, 2]


def test_bad_batch_is_refused(store):
    with pytest.raises(Exception, match="missing or bad field"):
        store.ingest(json.dumps([wire(3, 1, 1, 1), {"trace_id": 3}]))
    assert sorted(ids(store.traces())) == [1, 2]


def test_pruned_reads(store):
    """Reads by trace and by fields filter the scans, and agree with the full fold."""
    plan = store.trace(1)._jdf.queryExecution().toString()
    assert "trace_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    everything = store.spans().collect()
    for request, where in (({"sessionId": 7, "timeFrom": 2}, lambda r: r.session_id == 7 and r.max_ts >= 2), ({"tool": "sql", "status": 0}, lambda r: r.tool_name == "sql")):
        assert sorted(map(str, store.spans(request).collect())) == sorted(str(r) for r in everything if where(r))
    assert [(r.span_id, r.depth, r.place) for r in store.steps(1).orderBy("place").collect()] == [(1, 0, 0), (2, 1, 1)]


def test_log_events(store):
    store.ingest(json.dumps([wire(1, 1, 5, 4, logs=["b"]), wire(1, 1, 4, 4, logs=["a"]), wire(1, 1, 5, 4, logs=["again"])]))
    assert [(r.place, r.logs) for r in store.log_events(1).orderBy("place").collect()] == [(0, ["a"]), (1, ["b"])]
    assert [x.logs for x in store.span(1, 1).first().log_events] == [["a"], ["b"]]
    assert store.log_events(9).count() == 0  # another tenant's


def test_late_patches_and_compaction(store, spark):
    store.add_patches(spark.createDataFrame([(1, 2, "web", ["late"])], "trace_id long, span_id long, tool_name string, logs array<string>"))
    store.add_patches(spark.createDataFrame([(1, 2, {"k": '"v"'})], "trace_id long, span_id long, attrs map<string,string>"))
    got = store.span(1, 2).first()
    assert (got.tool_name, got.logs, got.attrs, got.duration_ns) == ("web", ["late"], {"k": '"v"'}, 9)
    assert [r.span_id for r in store.spans({"tool": "web"}).collect()] == [2]  # found by its late value
    before = sorted(map(str, store.spans().drop("logs").collect()))
    store.annotate(spark.createDataFrame([(5, 1, "keep")], "id long, trace_id long, label string"))
    store.retention_apply(store.batch)
    rows = store.table("events").count()
    store.compact()
    assert store.table("deletes").count() == 0 and store.table("events").count() == rows - 1
    assert sorted(map(str, store.spans().drop("logs").collect())) == [x for x in before if "trace_id=2" not in x]


def test_datasets(store):
    assert store.create_dataset("empty") and not store.create_dataset("empty")
    assert store.collect_into_dataset("bad", F.col("status") == 1) == 1
    assert store.collect_into_dataset("bad", F.col("status").isNotNull()) == 2 and store.collect_into_dataset("bad", F.col("status").isNotNull()) == 0
    assert [(r.name, r.examples) for r in store.datasets().collect()] == [("bad", 3), ("empty", 0)]
    overall = store.eval_dataset("bad", keyword_score(["cannot"])).where("agent_name is null").first()
    assert (overall.scored, overall.passed) == (2, 1) and store.span(2, 1).first().eval_score is None
    assert store.eval_dataset("none", keyword_score(["x"])) is None


def test_policies_and_audits(store):
    from spanloom.operators.retention import Policy

    store.put_policy(Policy(2, "later", 10, {"ttl": 5}, next_run=50))
    store.put_policy(Policy(1, "planner", 10, {"cutoff": 100, "agent": "planner", "status": 1}, next_run=20))
    store.put_policy(Policy(3, "off", 10, {"ttl": 5}, enabled=False))
    assert [r.id for r in store.policies().collect()] == [1, 2, 3]
    assert [p.id for p in store.run_due_policies(30)] == [1]
    assert ids(store.traces()) == [1] and store.run_due_policies(35) == []
    assert [(r.id, r.next_run) for r in store.policies(limit=1).collect()] == [(1, 40)]
    audit = store.retention_audit(source="policy:1").first()
    assert audit.sample_ids == [2] and store.retention_audit(id=audit.id).count() == 1
    assert store.retention_audit(source="manual").count() == store.retention_audit(created_to=1).count() == 0


def test_candidate_budget(store):
    assert [r.total for r in store.trace_search({"text": "refund"}, limit=1, candidate_budget=True).collect()] == [1]
