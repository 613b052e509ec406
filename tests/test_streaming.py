import json

from spanloom.operators.fold import fold
from spanloom.streaming import ingest


def test_files_to_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda s, n, k, **x: json.dumps({"trace_id": 1, "span_id": s, "ts": 1_000_000_000 * n, "seq": n, "event_type": k, "ext_span_id": f"e{s}", **x})
    (folder / "a.json").write_text("\n".join([row(1, 1, 1, status=0), row(1, 2, 2, duration_ns=5), row(2, 1, 1), json.dumps({"trace_id": 1})]))
    (folder / "b.json").write_text(row(1, 2, 2, duration_ns=5))  # a retry
    stream = ingest.deduplicated(ingest.event_stream(spark, str(folder)))
    ingest.append(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 3 and ingest.bad_rows(spark, str(folder)).count() == 1
    got = {r.span_id: (r.status, r.duration_ns, r.has_end) for r in fold(table).collect()}
    assert got == {1: (0, 5, True), 2: (None, None, False)}


def test_live_views(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"trace_id": 1, "span_id": 1, "ts": n, "seq": n, "event_type": n, "ext_span_id": "e", "session_id": 5, "status": n - 1, "input_tokens": 3}) for n in (1, 2)))
    e = ingest.event_stream(spark, str(folder))
    for view, name in ((ingest.live_spans(e), "live_spans"), (ingest.live_sessions(e), "live_sessions")):
        view.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    r = spark.table("live_spans").first()
    assert (r.status, r.has_start, r.has_end, r.event_count) == (1, True, True, 2)
    s = spark.table("live_sessions").first()
    assert (s.events, s.input_tokens, s.errors) == (2, 6, 1)
