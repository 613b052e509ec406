"""The fold: append-only events to complete spans.

Scalar fields take the last value that is not null in the order (seq, arrival); logs are the
ordered union without repeats; attributes are merged key by key, later events winning.  All of
it is one window on (trace_id, span_id), so unused fields are pruned from the scan, and what is sorted
are the events as they are: aggregation buffers of all fields are several times as wide, and every row
has one.  Events that are dealt by trace_id are folded where they are, and per-trace operators over the
spans need no shuffle either; other events are shuffled by span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import END, EXTERNAL, SCALARS, START, column_type

KEYS = ("trace_id", "span_id")
IDENTITY = ("ext_span_id", "seq", "event_type")


def deduplicate(events: DataFrame, arrival: str = "_arrival") -> DataFrame:
    """The first arrival of each event identity; the trace is not part of it."""
    order = Window.partitionBy(*IDENTITY).orderBy(arrival)
    return events.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def delete_rows(events: DataFrame, deletes: DataFrame, on: Sequence[str] = ("segment_id", "row_id")) -> DataFrame:
    """Rows that no deletion vector names."""
    return events.join(deletes.select(*on).distinct(), list(on), "left_anti")


def last_value(column: str | Column, order: Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.max_by(c, F.when(c.isNotNull(), order))


def first_value(column: str | Column, order: Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.min_by(c, F.when(c.isNotNull(), order))


def _log_rows(order: Sequence[str]) -> Column:
    """Aggregate: the logs of events with what orders them."""
    return F.collect_list(F.when(F.col("logs").isNotNull(), F.struct(*order, "logs")))


def _logs(rows: Column) -> Column:
    many = F.flatten(F.transform(F.sort_array(rows), lambda x: x["logs"]))
    return F.array_distinct(F.when(F.size(rows) == 1, F.get(rows, F.lit(0))["logs"]).otherwise(many))


def merge_logs(order: Sequence[str] = ("seq", "_arrival")) -> Column:
    return _logs(_log_rows(order))


def last_wins(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last one counts.

    Entries with repeated keys are sorted by key and place, and of each run the last one stays.
    """
    keys = F.transform(entries, lambda e: e["key"])
    placed = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))

    def ends(run: Column) -> Column:
        last = F.filter(run, lambda e, i: ~F.coalesce(F.get(run, i + 1)["key"] == e["key"], F.lit(False)))
        return F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))

    # as the argument of a lambda the sorted entries are made once
    kept = F.get(F.transform(F.array(placed), ends), F.lit(0))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(entries)).otherwise(F.map_from_entries(kept))


def _attr_rows(order: Sequence[str]) -> Column:
    """Aggregate: the attributes of events with what orders them."""
    return F.collect_list(F.when(F.col("attrs").isNotNull(), F.struct(*order, F.map_entries("attrs").alias("e"))))


def _attrs(rows: Column) -> Column:
    many = last_wins(F.flatten(F.transform(F.sort_array(rows), lambda x: x["e"])))
    return F.when(F.size(rows) == 1, F.map_from_entries(F.get(rows, F.lit(0))["e"])).otherwise(many)


def merge_attrs(order: Sequence[str] = ("seq", "_arrival")) -> Column:
    return _attrs(_attr_rows(order))


def fold(events: DataFrame, patches: DataFrame | None = None, unique: bool = False, sort: bool = False) -> DataFrame:
    """One row per (trace_id, span_id).

    ``unique`` skips the de-duplication where the source guarantees single events.  Columns that
    ``events`` lacks come out null.  ``patches`` are late values, see ``overlay``.
    """
    have = set(events.columns)
    missing = [c for c in (*SCALARS, "logs", "attrs", "ts") if c not in have]
    for c in missing:
        kind = column_type(c).simpleString()
        events = events.withColumn(c, F.lit(None).cast(kind))
    if "_arrival" not in have:
        events = events.withColumn("_arrival", F.lit(0).cast("long"))
    if not unique:
        events = deduplicate(events)
    order = ("seq", "_arrival")
    placed = Window.partitionBy(*KEYS).orderBy(*order)
    whole = placed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = events.select(
        *KEYS,
        *[F.last(c, ignorenulls=True).over(whole).alias(c) for c in SCALARS],
        _log_rows(order).over(whole).alias("logs"),
        _attr_rows(order).over(whole).alias("attrs"),
        F.bool_or(F.col("event_type") == START).over(whole).alias("has_start"),
        F.bool_or(F.col("event_type") == END).over(whole).alias("has_end"),
        F.count("*").over(whole).alias("event_count"),
        F.min("ts").over(whole).alias("min_ts"),
        F.max("ts").over(whole).alias("max_ts"),
        F.row_number().over(placed).alias("__n"),
    )
    spans = found.where("__n = 1").drop("__n").withColumns({"logs": _logs(F.col("logs")), "attrs": _attrs(F.col("attrs"))})
    if patches is not None:
        spans = overlay(spans, patches)
    return spans.orderBy(*KEYS) if sort else spans


def overlay(spans: DataFrame, patches: DataFrame, order: Sequence[str] = ("segment_id",)) -> DataFrame:
    """Lay late values over folded spans: patches of a span are merged in order, then win where they have a value."""
    fields = [c for c in SCALARS if c in patches.columns]
    by = F.struct(*order)
    aggs = [last_value(c, by).alias(f"p_{c}") for c in fields]
    if "logs" in patches.columns:
        aggs.append(merge_logs(order).alias("p_logs"))
    if "attrs" in patches.columns:
        aggs.append(merge_attrs(order).alias("p_attrs"))
    merged = patches.groupBy(*KEYS).agg(*aggs)
    out = spans.join(merged, list(KEYS), "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"p_{c}", c)).drop(f"p_{c}")
    if "logs" in patches.columns:
        empty = F.array().cast("array<string>")
        out = out.withColumn("logs", F.array_distinct(F.concat(F.coalesce("logs", empty), F.coalesce("p_logs", empty)))).drop("p_logs")
    if "attrs" in patches.columns:
        none = F.array().cast("array<struct<key:string,value:string>>")
        entries = F.concat(F.coalesce(F.map_entries("attrs"), none), F.coalesce(F.map_entries("p_attrs"), none))
        out = out.withColumn("attrs", last_wins(entries)).drop("p_attrs")
    return out


def lifecycle() -> Column:
    s, e = F.col("has_start"), F.col("has_end")
    return F.when(s & e, "completed").when(s, "running").when(e, "orphan_end").otherwise("incomplete")


def status_label() -> Column:
    failed = F.coalesce(F.col("status") != 0, F.lit(False))
    state = lifecycle()
    return (
        F.when(failed, "error")
        .when((F.col("status") == 0) | (state == "completed"), "ok")
        .when(state == "running", "run")
        .otherwise("incomplete")
    )


def candidate_events(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events of candidate spans only: the first phase of a filtered read finds keys, this one their rows."""
    return events.join(keys.select(*KEYS).distinct(), list(KEYS), "left_semi")


__all__ = ["EXTERNAL", "candidate_events", "deduplicate", "delete_rows", "fold", "lifecycle", "overlay", "status_label"]
