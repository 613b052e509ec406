"""Trees, depths, trajectories, their groups and differences, and agent graphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import attr_label
from .readmodels import cache_coverage, console_actor, is_error, token_sums

MAX_DEPTH = 64


def _meetings(spans: DataFrame, *columns: str) -> DataFrame:
    """Two rows a span: where it is a parent (``child`` false, at its own id) and where it is a child (at its parent's id)."""
    roles = F.array(
        F.struct(F.col("span_id").alias("at"), F.lit(False).alias("child")), F.struct(F.col("parent_span_id").alias("at"), F.lit(True).alias("child"))
    )
    return spans.select("trace_id", "span_id", *columns, F.inline(roles))


def trace_tree(spans: DataFrame) -> DataFrame:
    """Roots and, for each span with children, the children by id; a missing parent makes a root.

    Parents and children meet by a grouping, so the spans are read once.
    """
    met = _meetings(spans).groupBy("trace_id", "at").agg(
        (~F.bool_and("child")).alias("found"), F.collect_list(F.when(F.col("child"), F.col("span_id"))).alias("children")
    )
    linked = met.select("trace_id", F.when(F.col("found"), F.col("at")).alias("parent"), F.explode("children").alias("span_id"))
    return linked.groupBy("trace_id", "parent").agg(F.sort_array(F.collect_list("span_id")).alias("children"))


#: Stands for no parent in maps of parents.
NO_SPAN = -(1 << 63)


def _parent_map() -> Column:
    """Aggregate: the parents of a trace's spans."""
    return F.map_from_entries(F.collect_list(F.struct("span_id", F.coalesce("parent_span_id", F.lit(NO_SPAN)).alias("p"))))


def _climb(span: Column) -> Column:
    """Parent hops of a span over the map ``up``; a missing parent still counts as one; 64 hops at most, one more on a cycle.

    No path has more hops than the trace has spans; one that does not end by then is on a cycle.
    """
    nothing = F.lit(None).cast("long")

    def step(state: Column, _: Column) -> Column:
        parent = F.when(state["at"].isNotNull(), F.col("up")[state["at"]])
        real = parent.isNotNull() & (parent != F.lit(NO_SPAN))
        return F.struct(F.when(real, parent).otherwise(nothing).alias("at"), (state["n"] + F.when(real, 1).otherwise(0)).alias("n"))

    hops = F.sequence(F.lit(0), F.least(F.lit(MAX_DEPTH), F.size("up")))
    endless = lambda s: F.when(s["at"].isNotNull(), MAX_DEPTH + 1).otherwise(s["n"])
    return F.aggregate(hops, F.struct(span.alias("at"), F.lit(0).alias("n")), step, endless).cast("long")


def depths(spans: DataFrame) -> DataFrame:
    """Parent hops of every span, at most 64 and one more on a cycle.

    Each trace walks within one row, over the map of its spans' parents, so there is one shuffle
    on the trace and no recursion over the table.
    """
    ups = spans.groupBy("trace_id").agg(_parent_map().alias("up"), F.collect_list("span_id").alias("ids"))
    return ups.select("trace_id", F.inline(F.transform("ids", lambda i: F.struct(i.alias("span_id"), _climb(i).alias("depth")))))


def walk(spans: list[tuple[int, int | None]]) -> list[int]:
    """Ids of (id, parent) pairs, depth first from the roots, children by id; of any depth.

    A missing parent makes a root; spans on a cycle hang from no root and are left out.
    """
    known = {s for s, _ in spans}
    children: dict[int | None, list[int]] = {}
    for s, p in sorted(spans, key=lambda x: x[0], reverse=True):
        children.setdefault(p if p in known else None, []).append(s)
    out, open_ = [], children.get(None, [])
    while open_:
        s = open_.pop()
        out.append(s)
        open_ += children.get(s, ())
    return out


def depth_first(spans: DataFrame) -> DataFrame:
    """Place of each span on a depth-first walk of its trace, see ``walk``; trees may be of any depth.

    A trace's ids are one row; the walk itself, which has no form as an expression, runs over Arrow batches.
    """
    traces = spans.groupBy("trace_id").agg(F.collect_list(F.struct("span_id", "parent_span_id")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walks = [walk([(x["span_id"], x["parent_span_id"]) for x in row]) for row in batch["spans"].to_pylist()]
            sizes = [len(w) for w in walks]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch["trace_id"].to_numpy(), sizes), pa.int64()),
                    pa.array(chain.from_iterable(walks), pa.int64()),
                    pa.array(chain.from_iterable(map(range, sizes)), pa.int64()),
                ],
                names=["trace_id", "span_id", "place"],
            )

    return traces.mapInArrow(run, "trace_id long, span_id long, place long")


def step_kind() -> Column:
    return F.when(F.col("tool_name").isNotNull(), "tool").when(F.col("model").isNotNull(), "llm").when(F.col("agent_name").isNotNull(), "agent").otherwise("span")


def step_name() -> Column:
    return F.coalesce("tool_name", "agent_name", "model", F.get("logs", F.lit(0)), F.concat(F.lit("span-"), F.col("span_id").cast("string")))


def step_key() -> Column:
    """kind|name|tool|model|status, separators inside a part replaced."""
    parts = [step_kind(), step_name(), F.coalesce("tool_name", F.lit("")), F.coalesce("model", F.lit("")), F.coalesce(F.col("status").cast("string"), F.lit(""))]
    return F.concat_ws("|", *[F.translate(p, "|>", "//") for p in parts])


def span_failed() -> Column:
    bad = F.lower(attr_label(F.col("attrs")["validation_status"])).isin("fail", "failed", "error")
    return is_error() | F.coalesce(bad, F.lit(False))


def trajectories(spans: DataFrame) -> DataFrame:
    """Each trace as its ordered steps, their signature and a summary: one grouping of the folded spans."""
    item = F.struct("span_id", F.col("step"), "external_trace_id", "session_id")
    out = spans.withColumn("step", step_key()).groupBy("trace_id").agg(
        _parent_map().alias("up"),
        F.collect_list(item).alias("items"),
        F.count("*").alias("span_count"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"),
        F.sum(F.coalesce("duration_ns", F.lit(0))).alias("total_duration_ns"),
        *token_sums(),
        *cache_coverage(),
        F.bool_or(is_error()).alias("has_error"),
        (~F.bool_or(span_failed())).alias("success"),
    )
    placed = F.transform("items", lambda x: F.struct(_climb(x["span_id"]).alias("depth"), x["span_id"].alias("span_id"), x.alias("x")))
    # one row stays one row: the sorted steps are made once and read by name
    rest = [c for c in out.columns if c not in ("up", "items")]
    out = out.select(*rest, F.inline(F.array(F.struct(F.sort_array(placed).alias("path")))))

    def first(name: str) -> Column:
        return F.get(F.filter(F.transform("path", lambda p: p["x"][name]), lambda v: v.isNotNull()), F.lit(0))

    return out.select(
        "trace_id", F.transform("path", lambda p: p["x"]["step"]).alias("steps"), *rest[1:],
        first("external_trace_id").alias("external_trace_id"), first("session_id").alias("session_id"),
    ).withColumns({"signature": F.array_join("steps", ">"), "status": F.when(F.col("has_error"), "error").otherwise("ok")})


#: Piles that the traces of one signature are dealt into when its examples are looked for.
PILES = 64


def trajectory_groups(paths: DataFrame) -> DataFrame:
    """Traces with one signature; three lowest ids as examples.

    Traces of a signature are dealt into piles that mark their three lowest ids, so a frequent
    signature is not ordered in one task, and its group collects three ids a pile.
    """
    pile = F.pmod(F.xxhash64("trace_id"), F.lit(PILES))
    ranked = Window.partitionBy("signature", pile).orderBy("trace_id")
    summed = paths.withColumn("r", F.row_number().over(ranked)).groupBy("signature").agg(
        F.count("*").alias("trace_count"),
        F.sum("span_count").alias("span_count"),
        F.count_if("success").alias("success_count"),
        F.count_if("has_error").alias("error_count"),
        F.sum("total_duration_ns").alias("total_duration_ns"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.collect_list(F.when(F.col("r") <= 3, F.col("trace_id"))).alias("examples"),
    )
    return summed.withColumn("examples", F.slice(F.sort_array("examples"), 1, 3))


def groups_page(groups: DataFrame, best: bool = False, limit: int = 50) -> DataFrame:
    first = [F.col("trace_count").desc(), F.col("success_count").desc()]
    return groups.orderBy(*(first[::-1] if best else first), "signature").limit(max(1, min(500, limit)))


def trace_diff(paths: DataFrame, base: int, candidate: int) -> DataFrame:
    """How a candidate trace differs from a base: common leading steps, the rest of both, and deltas."""
    fields = ("steps", "signature", "total_duration_ns", "input_tokens", "output_tokens", "span_count")
    sides = {"b": base, "c": candidate}
    both = paths.where(F.col("trace_id").isin(base, candidate)).groupBy().agg(
        *[F.max(F.when(F.col("trace_id") == i, F.struct(*fields))).alias(s) for s, i in sides.items()]
    )
    both = both.where("b is not null and c is not null").select(*[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in sides for f in fields])
    n = F.least(F.size("b_steps"), F.size("c_steps"))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("b_steps", i) != F.element_at("c_steps", i))
    prefix = F.coalesce(F.array_min(F.when(n > 0, same)) - 1, n)
    both = both.withColumn("common_prefix", prefix.cast("long"))
    at = F.col("common_prefix").cast("int")
    return both.select(
        (F.col("b_signature") == F.col("c_signature")).alias("same_signature"),
        "common_prefix",
        F.array_join(F.slice("b_steps", at + 1, F.size("b_steps")), ">").alias("missing"),
        F.array_join(F.slice("c_steps", at + 1, F.size("c_steps")), ">").alias("extra"),
        *[(F.col(f"c_{x}") - F.col(f"b_{x}")).alias(f"delta_{x}") for x in fields[2:]],
    )


def actor(kind: str = "engine") -> Column:
    """Actor of a span: tool, agent, or the span itself; the console's variant knows models too."""
    if kind == "console":
        return console_actor()
    return F.coalesce("tool_name", "agent_name", F.concat(F.lit("span:"), F.col("span_id").cast("string")))


def actor_kind() -> Column:
    return F.when(F.col("tool_name").isNotNull(), "tool").when(F.col("agent_name").isNotNull(), "agent").otherwise("other")


def agent_nodes(spans: DataFrame, kind: str = "engine") -> DataFrame:
    named = spans.withColumns({"actor": actor(kind), "kind": actor_kind()})
    return named.groupBy("trace_id", "actor").agg(
        F.min_by("kind", "span_id").alias("kind"), F.count("*").alias("span_count"), *token_sums(), *cache_coverage()
    )


def agent_edges(spans: DataFrame, kind: str = "engine") -> DataFrame:
    """Calls from one actor to another: parent and child spans of different actors."""
    named = spans.select("trace_id", "span_id", "parent_span_id", actor(kind).alias("actor"))
    calls = _meetings(named, "actor").where("at is not null").groupBy("trace_id", "at", "child", "actor").agg(F.count("*").alias("n"))
    # a span has one actor; its children's are counted before they meet it
    met = calls.groupBy("trace_id", "at").agg(
        F.max(F.when(~F.col("child"), F.col("actor"))).alias("source"), F.collect_list(F.when(F.col("child"), F.struct(F.col("actor").alias("target"), "n"))).alias("called")
    )
    return (
        met.where("source is not null").select("trace_id", "source", F.inline("called"))
        .where("source <> target")
        .groupBy("trace_id", "source", "target")
        .agg(F.sum("n").alias("calls"))
    )
