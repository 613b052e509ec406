"""Roll-ups over folded spans: traces, sessions, costs, aggregates, storage, loops, tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import attr_label, cost, json_literal, shorten
from ..ids import event_id, unsigned_order
from ..schema import EXTERNAL, SCALARS, TOKENS
from .fold import deduplicate, first_value, status_label

SPAN_ORDER = ("trace_id", "span_id")
#: Piles of matches that a search counts and cuts before they meet.
PILES = 64


def is_error() -> Column:
    return F.coalesce(F.col("status") != 0, F.lit(False))


def is_llm() -> Column:
    return F.col("model").isNotNull() | F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in TOKENS], F.lit(False))


def token_sums() -> list[Column]:
    """Input and output tokens count null as 0; cache tokens stay null where no span reported any."""
    return [
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    ]


def cache_coverage() -> list[Column]:
    return [
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.count("cache_read_tokens").alias("cache_read_reported"),
        F.sum("cache_write_tokens").alias("cache_write_tokens"),
        F.count("cache_write_tokens").alias("cache_write_reported"),
        F.count_if(is_llm()).alias("total_llm_spans"),
    ]


def durations() -> list[Column]:
    return [F.sum("duration_ns").alias("total_duration_ns"), F.max("duration_ns").alias("max_duration_ns")]


def list_traces(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"),
        *durations(),
        F.count_if(is_error()).alias("error_count"),
        *token_sums(),
        *cache_coverage(),
        first_value("external_trace_id", F.struct("span_id")).alias("external_trace_id"),
    )


def list_sessions(spans: DataFrame) -> DataFrame:
    return spans.where("session_id is not null").groupBy("session_id").agg(
        F.count_distinct("trace_id").alias("trace_count"), F.count("*").alias("span_count"), *token_sums(), *cache_coverage()
    )


def cost_by_agent(spans: DataFrame) -> DataFrame:
    return spans.where("agent_name is not null").groupBy("agent_name").agg(
        F.count("*").alias("span_count"), *token_sums(), *cache_coverage()
    )


def console_sessions(spans: DataFrame, matching: Column | None = None) -> DataFrame:
    """Sessions as a console lists them; with a predicate, whole sessions that have a matching span."""
    own = spans.where("session_id is not null")
    order = F.struct(*SPAN_ORDER)
    label = status_label()
    found = own.groupBy("session_id").agg(
        F.bool_or(F.lit(True) if matching is None else F.coalesce(matching, F.lit(False))).alias("__match"),
        first_value("external_session_id", order).alias("external_session_id"),
        F.coalesce(first_value("agent_name", order), F.concat(F.lit("会话 "), F.first("session_id").cast("string"))).alias("title"),
        F.count_distinct("trace_id").alias("turn_count"),
        *token_sums(),
        *cache_coverage(),
        F.bool_or(label == "error").alias("has_error"),
        F.bool_or(label == "run").alias("has_running"),
        F.min("trace_id").alias("first_trace"),
    )
    return (found if matching is None else found.where("__match")).drop("__match")


def sessions_page(sessions: DataFrame, text: str | None = None) -> DataFrame:
    """Sessions whose title or id holds the text, with cost, newest id first when paged."""
    if text:
        sessions = sessions.where(F.col("title").contains(text) | F.col("session_id").cast("string").contains(text))
    return sessions.withColumns({"cost": cost(F.col("input_tokens"), F.col("output_tokens")), "started_at": F.col("session_id")})


GROUP_FIELDS = ("trace_id", "span_id", "session_id", "status", "agent_name", "tool_name", "model")
_GROUP_ALIASES = {"traceId": "trace_id", "spanId": "span_id", "sessionId": "session_id", "agent": "agent_name", "agentName": "agent_name", "tool": "tool_name", "toolName": "tool_name"}


def group_key(name: str) -> Column:
    """A group key as its JSON literal; names that are no field are attribute keys."""
    name = _GROUP_ALIASES.get(name, name)
    if name in GROUP_FIELDS:
        return json_literal(F.col(name), name.endswith("_name") or name == "model")
    return F.coalesce(F.col("attrs")[name], F.lit("null"))


def trace_aggregate(spans: DataFrame, group_by: Sequence[str], matching: Column | None = None) -> DataFrame:
    if matching is not None:
        spans = spans.where(matching)
    keys = [group_key(g).alias(f"key_{i}") for i, g in enumerate(group_by)]
    return spans.groupBy(*keys).agg(
        F.count("*").alias("span_count"),
        F.count_distinct("trace_id").alias("trace_count"),
        F.count_if(is_error()).alias("error_count"),
        F.coalesce(F.sum("duration_ns"), F.lit(0)).alias("total_duration_ns"),
        F.coalesce(F.max("duration_ns"), F.lit(0)).alias("max_duration_ns"),
        *token_sums(),
        *cache_coverage(),
    )


def aggregate_page(aggregated: DataFrame, limit: int = 50) -> DataFrame:
    keys = sorted((c for c in aggregated.columns if c.startswith("key_")), key=lambda c: int(c[4:]))
    return aggregated.orderBy(F.col("span_count").desc(), *keys).limit(max(1, limit))


def estimated_bytes() -> Column:
    """96 a span, and the octets of its ids, names, texts, logs and attributes."""
    fields = (*EXTERNAL, "agent_name", "tool_name", "model", "input_text", "output_text")
    total = F.lit(96).cast("long")
    for c in fields:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    zero = F.lit(0).cast("long")
    logs = F.aggregate(F.coalesce("logs", F.array().cast("array<string>")), zero, lambda a, x: a + F.octet_length(x))
    attrs = F.aggregate(
        F.coalesce(F.map_entries("attrs"), F.array().cast("array<struct<key:string,value:string>>")), zero,
        lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]),
    )
    return total + logs + attrs


def storage_stats(spans: DataFrame, group_by: Sequence[str] = (), matching: Column | None = None) -> DataFrame:
    if matching is not None:
        spans = spans.where(matching)
    keys = [group_key(g).alias(f"key_{i}") for i, g in enumerate(group_by)]
    return spans.groupBy(*keys).agg(
        F.count_distinct("trace_id").alias("trace_count"),
        F.count("*").alias("span_count"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"),
        F.coalesce(F.sum(estimated_bytes()), F.lit(0)).alias("estimated_bytes"),
    )


def search_order(sort: str | None) -> list[Column]:
    """Order of a trace search; ties go to the trace and the span."""
    tie = [F.col("trace_id"), F.col("span_id")]
    if sort == "duration":
        return [F.col("duration_ns").desc_nulls_last(), *tie]
    if sort == "tokens":
        return [(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).desc(), *tie]
    if sort == "status":
        return [F.coalesce("status", F.lit(0)).desc(), *tie]
    return tie


def trace_search(spans: DataFrame, matching: Column, sort: str | None = None, cursor: int = 0, limit: int | None = None) -> DataFrame:
    """Matching spans in order, a page of them, with the total before paging.

    Matches are dealt into PILES, each of which counts its rows and keeps as many as the page may
    need; only those meet.  So the fold runs once for the page and the total.
    """
    from .predicates import page, page_size

    order = search_order(sort)
    pile = F.pmod(F.xxhash64(*SPAN_ORDER), F.lit(PILES)).alias("__pile")
    whole = Window.partitionBy("__pile")
    found = spans.where(matching).select("*", pile)
    kept = found.withColumns({"__n": F.count("*").over(whole), "__r": F.row_number().over(whole.orderBy(*order))})
    kept = kept.where(F.col("__r") <= max(0, cursor) + page_size(limit))
    total = F.sum(F.when(F.col("__r") == 1, F.col("__n"))).over(Window.partitionBy()).alias("total")
    return page(kept.select("*", total).drop("__pile", "__n", "__r"), order, cursor, limit)


def log_events(events: DataFrame, unique: bool = False) -> DataFrame:
    """Raw events with logs: each identity once (the first to arrive), with its number and its place in the trace by time, sequence and id.

    ``unique`` skips the de-duplication where the source guarantees single events.
    """
    once = events if unique else deduplicate(events)
    number = event_id(F.col("ext_span_id"), F.col("seq"), F.col("event_type"))
    # the number decides among events of one time and sequence only; where it is not read, other events need no hash
    tied = F.count("*").over(Window.partitionBy("trace_id", "ts", "seq")) > 1
    named = once.where(F.size("logs") > 0).withColumn("__tied", tied).withColumn("event_id", number)
    order = Window.partitionBy("trace_id").orderBy("ts", "seq", F.when(F.col("__tied"), unsigned_order(number)))
    return named.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select(
        "trace_id", "span_id", "ts", "seq", "event_type", "ext_span_id", "event_id", "place", "logs"
    )


def waterfall(spans: DataFrame) -> DataFrame:
    """Logical start of each span: the durations of the spans before it."""
    before = Window.partitionBy("trace_id").orderBy("span_id").rowsBetween(Window.unboundedPreceding, -1)
    took = F.coalesce("duration_ns", F.lit(0))
    return spans.withColumn("logical_start_ns", F.coalesce(F.sum(took).over(before), F.lit(0)))


def console_kind() -> Column:
    return F.when(F.col("tool_name").isNotNull(), "tool").when(F.col("agent_name").isNotNull(), "agent").when(F.col("model").isNotNull(), "llm").otherwise("other")


def console_actor() -> Column:
    return F.coalesce(
        F.concat(F.lit("tool:"), "tool_name"), F.concat(F.lit("agent:"), "agent_name"), F.concat(F.lit("model:"), "model"),
        F.concat(F.lit("span:"), F.col("span_id").cast("string")),
    )


def trace_status(labels: Column | None = None) -> Column:
    """Aggregate: the gravest label of a trace: error, run, incomplete, ok."""
    label = status_label() if labels is None else labels
    rank = F.when(label == "error", 3).when(label == "run", 2).when(label == "incomplete", 1).otherwise(0)
    worst = F.max(rank)
    return F.when(worst == 3, "error").when(worst == 2, "run").when(worst == 1, "incomplete").otherwise("ok")


def trace_detail(spans: DataFrame) -> DataFrame:
    """Console view of a trace's spans: kind, actor, label, logical start."""
    return waterfall(spans).select(
        "trace_id", "span_id", "parent_span_id", console_kind().alias("kind"), console_actor().alias("actor"),
        F.coalesce("tool_name", "agent_name", "model", F.concat(F.lit("span-"), F.col("span_id").cast("string"))).alias("name"),
        status_label().alias("label"), "duration_ns", "logical_start_ns", "input_text", "output_text",
    )


def trace_steps(spans: DataFrame) -> DataFrame:
    """The spans of a trace as steps: kind, name, depth, place by depth and id, and the texts."""
    from .trajectory import depths, step_kind, step_name

    deep = spans.join(depths(spans), list(SPAN_ORDER))
    order = Window.partitionBy("trace_id").orderBy("depth", "span_id")
    return deep.select(
        *SPAN_ORDER, "parent_span_id", step_kind().alias("kind"), step_name().alias("name"), "depth", (F.row_number().over(order) - 1).cast("long").alias("place"),
        status_label().alias("label"), "duration_ns", "input_text", "output_text",
    )


def trace_summaries(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(trace_status().alias("status"), F.count("*").alias("span_count"), *durations(), *token_sums())


def session_timeline(spans: DataFrame, parts: int | None = None) -> DataFrame:
    """Turns of each session: its traces in order, with the first input and the last answer.

    ``parts`` are those in which sessions meet, where they should grow with the input; Spark's own number otherwise.
    """
    turns = spans.where("session_id is not null").groupBy("session_id", "trace_id").agg(
        F.min_by("input_text", F.when(F.col("input_text").isNotNull(), F.col("span_id"))).alias("input_text"),
        F.max_by(F.struct("output_text", "eval_score"), F.when(F.col("output_text").isNotNull(), F.col("span_id"))).alias("answer"),
        F.sort_array(F.collect_set("agent_name")).alias("agents"),
        F.count("*").alias("span_count"),
        F.count_if(is_error()).alias("error_count"),
        F.sum(F.coalesce("duration_ns", F.lit(0))).alias("total_duration_ns"),
        *token_sums(),
    )
    if parts is not None:
        turns = turns.repartition(parts, "session_id")
    order = Window.partitionBy("session_id").orderBy("trace_id")
    return turns.withColumn("turn", (F.row_number().over(order) - 1).cast("long")).select(
        "session_id", "trace_id", "turn", "input_text", F.col("answer.output_text").alias("answer"),
        F.col("answer.eval_score").alias("eval_score"), "agents", "span_count", "error_count", "total_duration_ns", "input_tokens", "output_tokens",
    )


def turns(timeline: DataFrame) -> DataFrame:
    """Turns as a console lists them."""
    name = F.coalesce(shorten(F.col("input_text")), F.concat(F.lit("第"), (F.col("turn") + 1).cast("string"), F.lit("轮")))
    return timeline.select(
        "session_id", "turn", "trace_id", name.alias("name"),
        F.floor(F.col("total_duration_ns") / 1_000_000).cast("long").alias("dur_ms"),
        F.when(F.col("error_count") > 0, "error").otherwise("ok").alias("status"),
    )


def loops(spans: DataFrame, key: str = "loop_id") -> DataFrame:
    """Summary of the spans that share an attribute's label."""
    order = F.struct(*SPAN_ORDER)
    marked = spans.withColumn("loop", attr_label(F.col("attrs")[key])).where("loop is not null")
    return marked.groupBy("loop").agg(
        F.count_distinct("trace_id").alias("trace_count"),
        F.count("*").alias("span_count"),
        F.count_if(is_error()).alias("error_count"),
        F.sum(F.coalesce("duration_ns", F.lit(0))).alias("total_duration_ns"),
        *token_sums(),
        *cache_coverage(),
        first_value(attr_label(F.col("attrs")["project_id"]), order).alias("project"),
        first_value(attr_label(F.col("attrs")["task_fingerprint"]), order).alias("task"),
        first_value(attr_label(F.col("attrs")["validation_status"]), order).alias("validation"),
    )


def spans_of_matching_traces(spans: DataFrame, matching: Column) -> DataFrame:
    """All spans of every trace that has a matching one."""
    has = F.max(F.coalesce(matching, F.lit(False))).over(Window.partitionBy("trace_id"))
    return spans.withColumn("__match", has).where("__match").drop("__match")


def task_traces(spans: DataFrame, fingerprint: str, attrs: dict[str, str] | None = None) -> DataFrame:
    """Traces in which some span has the fingerprint and, each on any span, every further attribute."""
    from .predicates import attr_matches

    wanted = {"task_fingerprint": fingerprint, **(attrs or {})}
    flags = [F.bool_or(attr_matches(k, v)).alias(f"has_{i}") for i, (k, v) in enumerate(wanted.items())]
    found = spans.groupBy("trace_id").agg(*flags)
    for i in range(len(wanted)):
        found = found.where(F.col(f"has_{i}"))
    return found.select("trace_id")


def all_columns() -> tuple[str, ...]:
    return (*SPAN_ORDER, *SCALARS)
