"""Plans of the trace queries that keep a task's rows bounded."""

import re

import pytest
from pyspark.sql import functions as F

from spanloom.ids import unsigned
from spanloom.operators import fold as fo, readmodels as rm
from spanloom.plans import registry
from spanloom.sources import tables

from .conftest import SMALL
from .helpers import events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_once(spark):
    """Customers join the orders, so neither lines nor spans are dealt by customer; no aggregation buffers are sorted."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(registry.QUERIES["fold_spans"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+?)#", p)
    assert dealt.count("l_orderkey") == 1 and set(dealt) == {"l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "c_nationkey", "n_nationkey"}
    assert "ObjectHashAggregate" not in p and "SortAggregate" not in p


def test_parts_grow_with_the_lines(spark, monkeypatch):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(tables, "PART_BYTES", size // 40)
    assert 40 <= tables.trace_events(spark, SMALL).rdd.getNumPartitions() <= 42


@pytest.mark.parametrize("times, parts", [(50, 50), (400, 200), (2400, 200), (4800, 400)])
def test_dealing_holds_no_rows_in_memory(spark, monkeypatch, times, parts):
    """Up to 12 times 200 parts there are no more parts than a shuffle writes directly; beyond, they grow again."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(tables, "PART_BYTES", size / times)
    assert parts <= tables._parts(lines) <= parts + 1


def test_customers_are_hashed(spark):
    """Orders meet customers without a sort, which would hold more of the orders in one task the more there are."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")  # nation only
    try:
        p = plan(registry.QUERIES["retention_audit"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert re.search(r"ShuffledHashJoin \[o_custkey", p) and not re.search(r"Sort \[[oc]_custkey", p)


@pytest.mark.parametrize("name", ["trace_aggregate_fields", "console_sessions_matching", "trace_trajectories", "turns", "sessions_page"])
def test_query_deals_lines_directly(spark, monkeypatch, name):
    """A query deals its lines once, to no more parts than are written directly, and sorts no orders to find their customers."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(tables, "PART_BYTES", size // 400)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        p = plan(registry.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert re.findall(r"Exchange hashpartitioning\(l_orderkey#\w+, (\d+)\)", p) == ["200"]
    assert not re.search(r"Sort \[[oc]_custkey", p)


@pytest.mark.parametrize("name", ["turns", "session_timeline"])
@pytest.mark.parametrize("shuffle_partitions", ["4", "600"])
def test_parts_do_not_follow_shuffle_partitions(spark, monkeypatch, name, shuffle_partitions):
    """Lines are dealt, and sessions meet, in as many parts as the input asks for, be shuffles of fewer parts or of more."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(tables, "PART_BYTES", size // 400)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    try:
        p = plan(registry.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for key in ("l_orderkey", "o_orderkey", "session_id"):
        assert re.findall(rf"Exchange hashpartitioning\({key}#\w+, (\d+)\)", p) == ["200"]


@pytest.mark.parametrize("column", ["status", "agent_name"])
def test_unread_fields_are_pruned(spark, column):
    p = plan(fo.fold(tables.trace_events(spark, SMALL), unique=True).select("trace_id", "span_id", column))
    assert "l_partkey" in p and "l_extendedprice" in p  # they number the events
    assert "collect_list" not in p and p.count("last(") <= 2


def test_places_of_tied_log_events(spark):
    """Ties of time and sequence go by the event's number, as unsigned; other events are placed without it."""
    rows = [{"trace_id": 1, "span_id": s, "seq": q, "ts": 5, "logs": ["x"]} for q in (1, 2) for s in range(1, 9)] + [{"trace_id": 1, "span_id": 99, "seq": 3, "ts": 4, "logs": ["y"]}]
    got = rm.log_events(events(spark, rows)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(17)) and got[0].span_id == 99
    assert [(r.ts, r.seq, r.event_id & (1 << 64) - 1) for r in got] == sorted((r.ts, r.seq, r.event_id & (1 << 64) - 1) for r in got)
    hashed = plan(registry.QUERIES["log_event_places"](spark, SMALL))
    assert re.search(r"CASE WHEN [^,]*(__tied|> 1)", hashed)


def test_short_ids_need_no_decimals(spark):
    """Ids of up to 18 digits are read as they are; longer and odd ones as before."""
    want = {"0": 0, "007": 7, "+5": 5, "9" * 18: 10**18 - 1, "1" + "0" * 18: 10**18, str((1 << 64) - 1): -1, str(1 << 63): -(1 << 63), str(1 << 64): None, "-1": None, " 1": None, "": None, "x1": None}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", unsigned(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == want
    assert r"^\d{1,18}$" in plan(df)
