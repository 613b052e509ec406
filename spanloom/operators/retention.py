"""Retention: what may be deleted, what protects it, and policies that run when due."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from .readmodels import estimated_bytes

REASONS = ("annotation", "datasetAssociation", "snapshot", "evalLink", "pathMemory")
EVAL_KEYS = ("eval_run_id", "evalRunId", "eval_profile", "evalProfile", "eval_status", "evalStatus")
PATH_KEYS = ("path_memory_id", "pathMemoryId")


def has_any(attrs: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(attrs), F.array(*[F.lit(k) for k in keys])), F.lit(False))


def candidates(spans: DataFrame, matching: Column | None = None, cutoff: int | None = None, sizes: bool = False) -> DataFrame:
    """Traces that match and whose last event is not after the cutoff; with ``sizes`` also their spans, events and bytes."""
    match = F.lit(True) if matching is None else F.coalesce(matching, F.lit(False))
    more = [F.count("*").alias("span_count"), F.sum("event_count").alias("event_count"), F.sum(estimated_bytes()).alias("estimated_bytes")] if sizes else []
    found = spans.groupBy("trace_id").agg(F.bool_or(match).alias("__match"), F.max("max_ts").alias("last_ts"), *more)
    if matching is not None:
        found = found.where("__match")
    found = found.drop("__match")
    return found if cutoff is None else found.where(F.col("last_ts") <= cutoff)


def protections(annotations: DataFrame, associations: DataFrame, kinds: Sequence[str] = REASONS) -> DataFrame:
    """(trace_id, reason) of everything that protects a trace; deleted annotations do not."""
    live = annotations.where("status <> 'deleted'")
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    parts = {
        "annotation": [(live, F.lit(True))],
        "datasetAssociation": [(associations, F.lit(True))],
        "snapshot": [(associations, filled("snapshot_id") | filled("snapshot_hash"))],
        "evalLink": [(associations, filled("eval_run_id") | has_any(F.col("attrs"), EVAL_KEYS)), (live, has_any(F.col("attrs"), EVAL_KEYS))],
        "pathMemory": [(associations, has_any(F.col("attrs"), PATH_KEYS)), (live, has_any(F.col("attrs"), PATH_KEYS))],
    }
    rows = [df.where(cond).select("trace_id", F.lit(kind).alias("reason")) for kind in kinds for df, cond in parts[kind]]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


def plan(found: DataFrame, protected: DataFrame) -> DataFrame:
    """Candidates with their reasons, in fixed order, and whether they may be deleted."""
    rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    reasons = protected.groupBy("trace_id").agg(F.sort_array(F.collect_set(F.struct(rank.alias("r"), "reason"))).alias("rs"))
    joined = found.join(reasons, "trace_id", "left")
    return joined.select(
        *found.columns, F.coalesce(F.array_join(F.transform("rs", lambda x: x["reason"]), ","), F.lit("")).alias("reasons"),
        F.col("rs").isNull().alias("deletable"),
    )


def plan_stats(planned: DataFrame) -> DataFrame:
    """Traces, spans, events and bytes of candidates, protected and deletable ones, of a plan with ``sizes``."""
    sets = F.explode(F.array(F.lit("candidate"), F.when(F.col("deletable"), "deletable").otherwise("protected"))).alias("part")
    return planned.select("*", sets).groupBy("part").agg(
        F.count("*").alias("trace_count"), *[F.sum(c).alias(c) for c in ("span_count", "event_count", "estimated_bytes")]
    )


def apply(planned: DataFrame, events: DataFrame, live_after: int) -> tuple[DataFrame, DataFrame]:
    """(deletion rows, skipped traces): deletable traces without rows after the last flush lose their flushed rows."""
    wanted = planned.where("deletable").select("trace_id")
    live = events.where(F.col("_arrival") > live_after).select("trace_id").distinct()
    skipped = wanted.join(live, "trace_id", "left_semi")
    gone = wanted.join(live, "trace_id", "left_anti")
    rows = events.where(F.col("_arrival") <= live_after).join(gone, "trace_id", "left_semi").select("trace_id", "span_id", "seq", "event_type", "ext_span_id")
    return rows, skipped


def audit(deleted: DataFrame, source: str, created_at: int, sample: int = 100) -> DataFrame:
    """One row about a run; at most ``sample`` trace ids ride along."""
    ids = deleted.select("trace_id").distinct()
    few = ids.orderBy("trace_id").limit(sample).agg(F.collect_list("trace_id").alias("sample_ids"))
    total = ids.agg(F.count("*").alias("deleted_traces"))
    return total.crossJoin(few).withColumns({"source": F.lit(source), "created_at": F.lit(created_at)})


@dataclass(frozen=True)
class Policy:
    id: int
    name: str
    interval: int
    query: dict = field(default_factory=dict)
    enabled: bool = True
    next_run: int = 0

    def __post_init__(self):
        if not self.name or self.interval <= 0 or not ({"cutoff", "ttl"} & self.query.keys()):
            raise ValueError("a policy needs a name, an interval and a cutoff or a ttl")


def due_rows(policies: DataFrame, now: int, limit: int = 100) -> DataFrame:
    """Rows of a policy table that are due, oldest first, 100 at most."""
    return policies.where(F.col("enabled") & (F.col("next_run") <= now)).orderBy("next_run", "id").limit(max(1, min(100, limit)))


def due(policies: Sequence[Policy], now: int, limit: int = 100) -> list[Policy]:
    found = [p for p in policies if p.enabled and p.next_run <= now]
    return sorted(found, key=lambda p: (p.next_run, p.id))[: max(1, min(100, limit))]


def run_due(policies: Sequence[Policy], now: int, run: Callable[[Policy, int], None], limit: int = 100) -> list[Policy]:
    """Run what is due, oldest first; a ttl becomes a cutoff before now; the next run is an interval away."""
    done = []
    for p in due(policies, now, limit):
        run(p, p.query["cutoff"] if "cutoff" in p.query else now - p.query["ttl"])
        done.append(replace(p, next_run=now + p.interval))
    return done
