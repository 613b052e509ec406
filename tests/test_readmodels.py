import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import tokens
from spanloom.operators import fold as fo, readmodels as rm, retention as rt, trajectory as tj
from spanloom.operators.predicates import SearchFilter, from_request, truth
from spanloom.plans import registry
from spanloom.schema import TOKENS

from .helpers import events


def spans(spark, rows):
    return fo.fold(events(spark, rows))


def drawn(seed, n_traces=12):
    """Random folded spans as dicts; no two events of a span, so each event is its span."""
    rnd = random.Random(seed)
    maybe = lambda share, make: make() if rnd.random() < share else None
    rows = []
    for trace in rnd.sample(range(1, 5000), n_traces):
        session = maybe(0.8, lambda: rnd.randint(1, 4))
        for span in range(1, rnd.randint(2, 7)):
            rows.append({
                "trace_id": trace, "span_id": span, "session_id": session, "parent_span_id": maybe(0.7, lambda: rnd.randint(1, 7)), "status": maybe(0.8, lambda: rnd.randint(0, 2)),
                "duration_ns": maybe(0.9, lambda: rnd.randint(1, 999)), "agent_name": maybe(0.6, lambda: rnd.choice("ABC")), "tool_name": maybe(0.3, lambda: rnd.choice("xyz")),
                "model": maybe(0.3, lambda: "m"), "input_text": maybe(0.5, lambda: f"in {rnd.randint(0, 99)}"), "output_text": maybe(0.5, lambda: f"out {rnd.randint(0, 99)}"),
                **{c: maybe(0.5, lambda: rnd.randint(0, 50)) for c in TOKENS},
            })
    return rows


def grouped(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def total(rows, name):
    """Sum without nulls, null of nothing."""
    values = [r[name] for r in rows if r[name] is not None]
    return sum(values) if values else None


@pytest.fixture(scope="module")
def drawn_spans(spark):
    rows = drawn(17)
    return rows, spans(spark, rows)


def test_totals_of_traces_sessions_and_agents(drawn_spans):
    rows, s = drawn_spans
    for key, table in (("trace_id", rm.list_traces(s)), ("session_id", rm.list_sessions(s)), ("agent_name", rm.cost_by_agent(s))):
        want = {k: rs for (k,), rs in grouped(rows, key).items() if k is not None}
        got = {r[key]: r for r in table.collect()}
        assert set(got) == set(want)
        for k, rs in want.items():
            g = got[k]
            assert g.span_count == len(rs) and (g.input_tokens, g.output_tokens) == tuple(total(rs, c) or 0 for c in TOKENS[:2])
            # cache tokens that no span reports are not zero
            assert (g.cache_read_tokens, g.cache_write_tokens) == tuple(total(rs, c) for c in TOKENS[2:])
            assert g.cache_read_reported == sum(r["cache_read_tokens"] is not None for r in rs)
            assert g.total_llm_spans == sum(any(r[c] is not None for c in (*TOKENS, "model")) for r in rs)
            if key == "trace_id":
                times = [r["duration_ns"] for r in rs if r["duration_ns"] is not None]
                assert (g.total_duration_ns, g.max_duration_ns, g.error_count) == (total(rs, "duration_ns"), max(times, default=None), sum(bool(r["status"]) for r in rs))
            if key == "session_id":
                assert g.trace_count == len({r["trace_id"] for r in rs})


def test_turns_of_drawn_sessions(drawn_spans):
    rows, s = drawn_spans
    want = []
    for (session,), of_session in grouped(rows, "session_id").items():
        if session is not None:
            for turn, ((trace,), rs) in enumerate(sorted(grouped(of_session, "trace_id").items())):
                asked, said = ([r[c] for r in rs if r[c] is not None] for c in ("input_text", "output_text"))
                want.append((session, turn, trace, asked[0] if asked else None, said[-1] if said else None, sum(bool(r["status"]) for r in rs), total(rs, "duration_ns") or 0))
    got = rm.session_timeline(s).select("session_id", "turn", "trace_id", "input_text", "answer", "error_count", "total_duration_ns").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_graph_of_drawn_spans(drawn_spans):
    rows, s = drawn_spans
    name = lambda r: r["tool_name"] or r["agent_name"] or f"span:{r['span_id']}"
    at = {(r["trace_id"], r["span_id"]): r for r in rows}
    calls, nodes = Counter(), Counter()
    for r in rows:
        nodes[r["trace_id"], name(r)] += 1
        up = at.get((r["trace_id"], r["parent_span_id"]))
        if up and name(up) != name(r):
            calls[r["trace_id"], name(up), name(r)] += 1
    assert len(calls) > 5 and {(r.trace_id, r.source, r.target): r.calls for r in tj.agent_edges(s).collect()} == calls
    assert {(r.trace_id, r.actor): r.span_count for r in tj.agent_nodes(s).collect()} == nodes


def test_walk_of_any_depth():
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 5001)]
    random.Random(2).shuffle(chain)
    assert tj.walk(chain) == list(range(1, 5001))
    assert tj.walk([(3, 9), (1, 2), (2, 1), (5, 3), (4, 3)]) == [3, 4, 5]  # a missing parent makes a root, a cycle has none


def test_tree_walk_and_depth(spark):
    s = spans(spark, [
        {"trace_id": 1, "span_id": 1}, {"trace_id": 1, "span_id": 2, "parent_span_id": 1}, {"trace_id": 1, "span_id": 3, "parent_span_id": 1},
        {"trace_id": 1, "span_id": 4, "parent_span_id": 2}, {"trace_id": 2, "span_id": 1, "parent_span_id": 99}, {"trace_id": 3, "span_id": 1, "parent_span_id": 2}, {"trace_id": 3, "span_id": 2, "parent_span_id": 1},
    ])
    assert {(r.trace_id, r.parent): r.children for r in tj.trace_tree(s).where("trace_id = 1").collect()} == {(1, None): [1], (1, 1): [2, 3], (1, 2): [4]}
    assert [r.span_id for r in tj.depth_first(s).where("trace_id = 1").orderBy("place").collect()] == [1, 2, 4, 3]
    d = {(r.trace_id, r.span_id): r.depth for r in tj.depths(s).collect()}
    assert (d[1, 1], d[1, 4], d[2, 1], d[3, 1]) == (0, 2, 1, 65)


def test_filters(spark):
    s = spans(spark, [
        {"trace_id": 1, "span_id": 1, "ts": 100, "agent_name": "billing", "status": 0, "tenant_id": 1, "logs": ["see this"], "attrs": {"k": '"v"'}},
        {"trace_id": 2, "span_id": 1, "ts": 300, "agent_name": "billing", "status": 1, "tenant_id": 2, "external_trace_id": "run-2"},
    ])
    ids = lambda f: [r.trace_id for r in s.where(f.column()).orderBy("trace_id").collect()]
    assert ids(SearchFilter(agent_name="billing", status=1)) == [2]
    assert ids(SearchFilter(time_to=150)) == [1]
    assert ids(SearchFilter(text="this")) == [1]
    assert ids(SearchFilter(attrs={"k": '"v"'})) == [1] and ids(SearchFilter(attrs={"k": "v"})) == []
    assert ids(from_request({"traceId": "run-2", "tenantId": 1}, tenant_id=2)) == [2]
    assert truth("TRUE") and not truth("0")


def test_policies():
    p = rt.Policy(1, "old", 10, {"ttl": 5}, next_run=3)
    ran = []
    done = rt.run_due([p, rt.Policy(2, "later", 10, {"cutoff": 1}, next_run=99)], 50, lambda q, c: ran.append((q.id, c)))
    assert ran == [(1, 45)] and done[0].next_run == 60


def test_retention_of_drawn_traces(spark):
    rnd = random.Random(23)
    last = {t: rnd.randint(1, 100) for t in range(1, 30)}
    noted, linked, late = (set(rnd.sample(sorted(last), 8)) for _ in range(3))
    s = spans(spark, [{"trace_id": t, "span_id": n, "ts": ts - n} for t, ts in last.items() for n in range(2)])
    notes = spark.createDataFrame([(t, "deleted" if t % 2 else "active", None) for t in noted], "trace_id long, status string, attrs map<string,string>")
    links = spark.createDataFrame([(t, "", None, "run" if t % 3 else None, None) for t in linked], "trace_id long, snapshot_id string, snapshot_hash string, eval_run_id string, attrs map<string,string>")
    planned = rt.plan(rt.candidates(s, None, 60, sizes=True), rt.protections(notes, links))
    want = {}
    for t, ts in last.items():
        if ts <= 60:
            why = ["annotation"] * (t in noted and t % 2 == 0) + ["datasetAssociation"] * (t in linked) + ["evalLink"] * (t in linked and t % 3 > 0)
            want[t] = (",".join(why), not why)
    assert {r.trace_id: (r.reasons, r.deletable) for r in planned.collect()} == want
    parts = {r.part: (r.trace_count, r.span_count) for r in rt.plan_stats(planned).collect()}
    free = {t for t, (_, deletable) in want.items() if deletable}
    assert parts == {"candidate": (len(want), 2 * len(want)), "deletable": (len(free), 2 * len(free)), "protected": (len(want) - len(free), 2 * (len(want) - len(free)))}
    ev = events(spark, [{"trace_id": t, "span_id": 1} for t in last]).withColumn("_arrival", F.when(F.col("trace_id").isin(*late), 9).otherwise(1).cast("long"))
    rows, skipped = rt.apply(planned, ev, live_after=5)
    assert {r.trace_id for r in rows.collect()} == free - late and {r.trace_id for r in skipped.collect()} == free & late


def test_registered_over_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    q = registry.QUERIES
    detail = q["trace_detail_all"](spark, d)
    assert detail.count() == q["trace_summaries"](spark, d).agg(F.sum("span_count")).first()[0] > q["trace_detail"](spark, d).count()
    words = spark.read.parquet(f"{d}/documents.parquet").select(F.size(tokens(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0]
    assert q["tokenized_document_terms"](spark, d).agg(F.sum("n")).first()[0] == words


@pytest.mark.parametrize("name", ["list_traces", "trace_search_text", "trajectory_groups", "trace_diff", "agent_graph_edges", "trace_tree", "console_sessions_matching", "loop_trajectories"])
def test_one_fold_a_query(spark, name):
    """Each of the four tables under the events is scanned once, and events are dealt by trace once."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4 and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
