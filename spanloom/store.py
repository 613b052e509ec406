"""A trace store over Parquet folders: one object with every request of the query surface.

Tables are append-only.  Each append carries a batch number from the writer's clock, so one writer
at a time is assumed; a row's arrival is (batch, position within the batch).  Reads fold what the
folder holds when they are planned; requests return DataFrames and nothing is collected.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .operators import evaluate as ev, metadata as md, readmodels as rm, retention as rt, search as se, trajectory as tj
from .operators.fold import KEYS, candidate_events, deduplicate, fold
from .operators.predicates import SearchFilter, attr_matches, from_request, page, page_size
from .schema import EVENT, SCALARS, column_type
from .sources import otlp, wire

_META = "id bigint, version bigint, tenant_id bigint, trace_id bigint, span_id bigint, status string, label string, source string, attrs map<string,string>, created_at bigint"
#: Tables besides the events, with their columns.
TABLES = {
    "patches": ", ".join(["trace_id bigint", "span_id bigint", *[f"{c} {column_type(c).simpleString()}" for c in (*SCALARS, "logs", "attrs")], "segment_id bigint"]),
    "deletes": "trace_id bigint, upto bigint",
    "vectors": "trace_id bigint, span_id bigint, embedding array<float>, segment_id bigint",
    "annotations": f"{_META}, target string, value string",
    "associations": f"{_META}, dataset_id string, item_id string, eval_run_id string, split string, snapshot_id string, snapshot_hash string",
    "audits": "id bigint, source string, deleted_traces bigint, sample_ids array<bigint>, created_at bigint",
    "datasets": "name string, created_at bigint",
    "examples": "name string, trace_id bigint, span_id bigint, agent_name string, input_text string, output_text string, expected string",
    "policies": "id bigint, version bigint, name string, every bigint, request string, cutoff bigint, ttl bigint, enabled boolean, next_run bigint, created_at bigint",
}


class TraceStore:
    def __init__(self, spark: SparkSession, folder: str, tenant_id: int | None = None, embed: Callable[[str], Sequence[float]] | None = None):
        """``folder`` must be one that driver and executors share; ``tenant_id`` limits reads and marks writes."""
        self.spark, self.folder, self.tenant_id, self.embed = spark, folder.rstrip("/"), tenant_id, embed

    # tables

    def _schema(self, name: str) -> T.StructType:
        if name != "events":
            return T.StructType.fromDDL(TABLES[name])
        arrival = T.StructType.fromDDL("batch bigint, pos bigint")
        return T.StructType([T.StructField(f.name, arrival if f.name == "_arrival" else f.dataType) for f in EVENT])

    def _append(self, name: str, rows: DataFrame) -> None:
        have, fields = set(rows.columns), self._schema(name)
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        rows.select(*columns).write.mode("append").parquet(f"{self.folder}/{name}")

    def _path(self, name: str):
        """(file system, path) of a folder of the store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def table(self, name: str) -> DataFrame:
        """A table as it stands; one that nothing was written to is empty."""
        files, path = self._path(name)
        if not files.exists(path):
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.folder}/{name}")

    # writes

    def append_events(self, events: DataFrame) -> int:
        """Append events and return their batch number."""
        batch = time.time_ns()
        if self.tenant_id is not None:
            events = events.withColumn("tenant_id", F.lit(self.tenant_id).cast("long"))
        arrival = F.struct(F.lit(batch).cast("long").alias("batch"), F.monotonically_increasing_id().alias("pos"))
        self._append("events", events.withColumn("_arrival", arrival))
        return batch

    def _text(self, body: str) -> DataFrame:
        return self.spark.createDataFrame([(body,)], "value string")

    def ingest(self, body: str) -> int:
        """A JSON array of wire events; a bad row refuses the whole batch."""
        return self.append_events(wire.parse(self._text(body), tenant_id=self.tenant_id))

    def ingest_files(self, path: str) -> int:
        """Files of wire events, read in parallel."""
        return self.append_events(wire.read(self.spark, path, self.tenant_id))

    def ingest_otlp(self, body: str, vendor: str | None = None) -> int:
        return self.append_events(otlp.parse(self._text(body), tenant_id=self.tenant_id, vendor=vendor))

    def add_vectors(self, vectors: DataFrame) -> None:
        """(trace_id, span_id, embedding); the last vector of a span counts."""
        self._append("vectors", vectors.withColumn("segment_id", F.lit(time.time_ns()).cast("long")))

    def add_patches(self, patches: DataFrame) -> None:
        """Late values of spans: (trace_id, span_id) and any of the scalar fields, logs and attrs; later ones win."""
        self._append("patches", patches.withColumn("segment_id", F.lit(time.time_ns()).cast("long")))

    def compact(self) -> None:
        """Rewrite the events without those that deletions cover; readers of the old files must be done."""
        files, path = self._path("events")
        if not files.exists(path):
            return
        fresh, gone = self._path("events-new")[1], self._path("deletes")[1]
        files.delete(fresh, True)
        self.events().write.parquet(f"{self.folder}/events-new")
        files.delete(path, True)
        files.rename(fresh, path)
        files.delete(gone, True)

    def write_scores(self, score: Column, label: Column | None = None, request: dict | None = None) -> DataFrame:
        """Score matching spans, write the scores back and return the summary of what is stored."""
        found = ev.evaluate(self.spans(request), score, label)
        self._append("patches", found.drop("agent_name").withColumn("segment_id", F.lit(time.time_ns()).cast("long")))
        return self.eval_summary()

    # spans

    def events(self) -> DataFrame:
        """Events that no deletion covers."""
        gone = self.table("deletes").groupBy("trace_id").agg(F.max("upto").alias("upto")).withColumnRenamed("trace_id", "__gone")
        events = self.table("events")
        covered = (F.col("trace_id") == F.col("__gone")) & (F.col("_arrival.batch") <= F.col("upto"))
        return events.join(gone, covered, "left_anti")

    def spans(self, request: dict | None = None) -> DataFrame:
        """Folded spans that the tenant sees and the request matches.

        A request by fields or by time is read in two phases: narrow columns give the keys of spans that
        may match, and only their events are folded.
        """
        wanted = from_request(request or {}, self.tenant_id)
        events, patches = self.events(), self.table("patches")
        keys = self._candidates(wanted, events, patches)
        if keys is not None:
            events, patches = candidate_events(events, keys), candidate_events(patches, keys)
        return fold(events, patches).where(wanted.column())

    @staticmethod
    def _candidates(wanted: SearchFilter, events: DataFrame, patches: DataFrame) -> DataFrame | None:
        """Keys of spans with every wanted value on one of their events or patches, within the time asked for; None if all may match."""
        fields = {c: v for c in SCALARS if (v := getattr(wanted, c, None)) is not None}
        if not fields and wanted.time_from is None and wanted.time_to is None:
            return None
        late = patches.select(*KEYS, F.lit(None).cast("long").alias("ts"), *fields)
        seen = events.select(*KEYS, "ts", *fields).unionByName(late).groupBy(*KEYS).agg(
            F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), *[F.bool_or(F.col(c) == v).alias(c) for c, v in fields.items()]
        )
        for c in fields:
            seen = seen.where(c)
        return seen.where(SearchFilter(time_from=wanted.time_from, time_to=wanted.time_to).column()).select(*KEYS)

    def _trace_spans(self, *trace_ids: int) -> DataFrame:
        """Folded spans of some traces: the filter reaches the scans of events and patches.  Of an event that two
        traces claim, each trace read by itself has its own first arrival."""
        own = F.col("trace_id").isin(*trace_ids)
        return fold(self.events().where(own), self.table("patches").where(own)).where(self._matching(None))

    def _matching(self, request: dict | None) -> Column:
        return from_request(request or {}, self.tenant_id).column()

    # read models

    def traces(self) -> DataFrame:
        return rm.list_traces(self.spans())

    def sessions(self) -> DataFrame:
        return rm.list_sessions(self.spans())

    def console_sessions(self, request: dict | None = None, text: str | None = None, cursor: int = 0, limit: int | None = None) -> DataFrame:
        """Whole sessions that have a matching span, newest id first."""
        found = rm.console_sessions(self.spans(), self._matching(request) if request else None)
        return page(rm.sessions_page(found, text), [F.col("session_id").desc()], cursor, limit)

    def session(self, session_id: int) -> DataFrame:
        return rm.session_timeline(self.spans({"session_id": session_id}))

    def turns(self, session_id: int) -> DataFrame:
        return rm.turns(self.session(session_id))

    def cost_by_agent(self) -> DataFrame:
        return rm.cost_by_agent(self.spans())

    def trace(self, trace_id: int) -> DataFrame:
        return rm.trace_detail(self._trace_spans(trace_id))

    def steps(self, trace_id: int) -> DataFrame:
        """The trace's spans with their texts, depth and place."""
        return rm.trace_steps(self._trace_spans(trace_id))

    def log_events(self, trace_id: int, span_id: int | None = None) -> DataFrame:
        """Raw log events of the trace's visible spans, in order."""
        visible = self._trace_spans(trace_id).select(*KEYS)
        own = self.events().where(F.col("trace_id") == trace_id)
        found = rm.log_events(own).join(visible, list(KEYS), "left_semi")
        return found if span_id is None else found.where(F.col("span_id") == span_id)

    def span(self, trace_id: int, span_id: int) -> DataFrame:
        """One span with its raw log events, an array in order of time."""
        logs = self.log_events(trace_id, span_id).groupBy(*KEYS).agg(
            F.sort_array(F.collect_list(F.struct("place", "ts", "seq", "event_type", "event_id", "logs"))).alias("log_events")
        )
        return self._trace_spans(trace_id).where(F.col("span_id") == span_id).join(logs, list(KEYS), "left")

    def trace_search(
        self, request: dict | None = None, sort: str | None = None, cursor: int = 0, limit: int | None = None, candidate_budget: bool = False
    ) -> DataFrame:
        """With ``candidate_budget`` a text search looks only at the best spans by BM25, as many as the page may need, 500 at most; ``total`` counts among them."""
        spans = self.spans(request)
        if candidate_budget and (request or {}).get("text"):
            spans = self._best_by_text(spans, request["text"], min(500, max(0, cursor) + page_size(limit)))
        return rm.trace_search(spans, F.lit(True), sort, cursor, limit)

    def _best_by_text(self, spans: DataFrame, text: str, budget: int) -> DataFrame:
        """The spans among the best by BM25 that the tenant sees; statistics are those of all."""
        hits = se.bm25(se.span_documents(deduplicate(self.events())), text, KEYS, None)
        seen = hits.join(self.spans().select(*KEYS), list(KEYS), "left_semi")
        return spans.join(seen.orderBy(F.col("score").desc(), *KEYS).limit(budget).select(*KEYS), list(KEYS), "left_semi")

    def trace_aggregate(self, group_by: Sequence[str], request: dict | None = None, limit: int = 50, candidate_budget: bool = False) -> DataFrame:
        spans = self.spans(request)
        if candidate_budget and (request or {}).get("text"):
            spans = self._best_by_text(spans, request["text"], page_size(limit))
        return rm.aggregate_page(rm.trace_aggregate(spans, group_by), limit)

    def storage_stats(self, group_by: Sequence[str] = (), request: dict | None = None) -> DataFrame:
        return rm.storage_stats(self.spans(request), group_by)

    def trace_tree(self, trace_id: int) -> DataFrame:
        return tj.trace_tree(self._trace_spans(trace_id))

    def agent_graph(self, request: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges)"""
        spans = self.spans(request)
        return tj.agent_nodes(spans), tj.agent_edges(spans)

    # trajectories, loops, tasks

    def trace_trajectories(self, request: dict | None = None) -> DataFrame:
        """Whole traces that have a matching span."""
        return tj.trajectories(rm.spans_of_matching_traces(self.spans(), self._matching(request)))

    def trajectory_groups(self, request: dict | None = None, best: bool = False, limit: int = 50) -> DataFrame:
        return tj.groups_page(tj.trajectory_groups(self.trace_trajectories(request)), best, limit)

    def trace_diff(self, base: int, candidate: int) -> DataFrame:
        return tj.trace_diff(tj.trajectories(self._trace_spans(base, candidate)), base, candidate)

    def loops(self, cursor: int = 0, limit: int | None = None) -> DataFrame:
        return page(rm.loops(self.spans()), [F.col("trace_count").desc(), F.col("loop")], cursor, limit)

    def loop(self, loop_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(summary, trajectories of its traces, its spans)"""
        spans = self.spans()
        own = attr_matches("loop_id", loop_id)
        return rm.loops(spans.where(own)), tj.trajectories(rm.spans_of_matching_traces(spans, own)), spans.where(own)

    def task_traces(self, fingerprint: str, attrs: dict[str, str] | None = None) -> DataFrame:
        spans = self.spans()
        found = rm.task_traces(spans, fingerprint, attrs)
        return tj.trajectories(spans.join(found, "trace_id", "left_semi"))

    # search

    def search(self, request: dict, k: int = 10) -> DataFrame:
        """The k best matching spans by text, vector or both: (trace_id, span_id, score or distance, the span's columns)."""
        text, vector = se.request_mode(request, self.embed)
        mode = se.search_mode(text, vector)
        spans = self.spans({x: v for x, v in request.items() if x not in ("text", "vector", "mode", "query")})
        visible = spans.select(*KEYS)
        pool = k if mode != "hybrid" else max(k, 10)
        hits = []
        if mode in ("text", "hybrid"):
            docs = se.span_documents(deduplicate(self.events()))
            found = se.bm25(docs, text or "", KEYS, k=None).join(visible, list(KEYS), "left_semi")
            hits.append(found.orderBy(F.col("score").desc(), *KEYS).limit(pool))
        if mode in ("vector", "hybrid"):
            newest = self.table("vectors").groupBy(*KEYS).agg(F.max_by("embedding", "segment_id").alias("embedding"))
            hits.append(se.knn(newest.join(visible, list(KEYS), "left_semi"), vector, KEYS, pool))
        best = se.hybrid(hits[0], hits[1], KEYS, k) if mode == "hybrid" else hits[0]
        return se.materialize(best, spans, KEYS)

    # evaluation

    def eval_summary(self, threshold: int = 600) -> DataFrame:
        return ev.eval_summary(self.spans(), threshold)

    def create_dataset(self, name: str) -> bool:
        """Whether it is new."""
        if not self.table("datasets").where(F.col("name") == name).isEmpty():
            return False
        self._append("datasets", self.spark.createDataFrame([(name, time.time_ns())], TABLES["datasets"]))
        return True

    def dataset(self, name: str) -> DataFrame:
        return self.table("examples").where(F.col("name") == name)

    def datasets(self) -> DataFrame:
        """(name, examples) by name, empty ones too."""
        counts = self.table("examples").groupBy("name").agg(F.count("*").alias("examples"))
        named = self.table("datasets").select("name").distinct().join(counts, "name", "left")
        return named.select("name", F.coalesce("examples", F.lit(0).cast("long")).alias("examples")).orderBy("name")

    def collect_into_dataset(self, name: str, matching: Column, expected: Column | None = None, request: dict | None = None) -> int:
        """Freeze matching spans that the dataset does not have yet; returns how many."""
        self.create_dataset(name)
        before = self.dataset(name)
        had = before.count()
        self._append("examples", ev.collect_into_dataset(before, self.spans(request), matching, expected).withColumn("name", F.lit(name)))
        return self.dataset(name).count() - had

    def eval_dataset(self, name: str, score: Column, threshold: int = 600) -> DataFrame | None:
        """Summary of the scores of frozen examples; nothing is written back.  None for a dataset that is not there."""
        if self.table("datasets").where(F.col("name") == name).isEmpty():
            return None
        return ev.eval_summary(ev.evaluate(self.dataset(name), score), threshold)

    # annotations and dataset associations

    def _add(self, name: str, rows: DataFrame) -> None:
        """First versions of new rows; ids are the caller's."""
        defaults = {"version": F.lit(1), "tenant_id": F.lit(self.tenant_id), "created_at": F.lit(time.time_ns())}
        if name == "annotations":
            defaults |= {"status": F.lit("active")}
        for c, v in defaults.items():
            own = c in rows.columns and c != "tenant_id"
            if not (c == "tenant_id" and self.tenant_id is None and c in rows.columns):
                rows = rows.withColumn(c, F.coalesce(F.col(c), v) if own else v)
        self._append(name, rows)

    def annotate(self, rows: DataFrame) -> None:
        self._add("annotations", rows)

    def associate(self, rows: DataFrame) -> None:
        self._add("associations", rows)

    def _current(self, name: str) -> DataFrame:
        found = md.latest(self.table(name))
        return found if self.tenant_id is None else found.where(F.col("tenant_id") == self.tenant_id)

    def annotations(self, cursor: int = 0, limit: int | None = None, **filters) -> DataFrame:
        found = self._current("annotations").where(md.annotation_filter(**filters))
        return page(found, md.newest(found), cursor, limit)

    def associations(self, cursor: int = 0, limit: int | None = None, **filters) -> DataFrame:
        found = self._current("associations").where(md.association_filter(**filters))
        return page(found, md.newest(found), cursor, limit)

    def update_annotations(self, changes: DataFrame, fields: tuple[str, ...], replace_attrs: bool = False) -> None:
        """See ``metadata.update``."""
        self._append("annotations", md.update(self._current("annotations"), changes, fields, self.tenant_id, replace_attrs))

    def delete_annotations(self, ids: DataFrame) -> None:
        self._append("annotations", md.soft_delete(self._current("annotations"), ids, self.tenant_id))

    # retention

    def retention_plan(self, request: dict | None = None, cutoff: int | None = None, sizes: bool = False) -> DataFrame:
        """Candidates, what protects them, and whether they may go."""
        found = rt.candidates(self.spans(), self._matching(request), cutoff, sizes)
        return rt.plan(found, rt.protections(self._current("annotations"), self._current("associations")))

    def retention_stats(self, request: dict | None = None, cutoff: int | None = None) -> DataFrame:
        return rt.plan_stats(self.retention_plan(request, cutoff, sizes=True))

    def retention_apply(self, upto: int, request: dict | None = None, cutoff: int | None = None, source: str = "manual") -> DataFrame:
        """Delete what the plan allows of batches up to ``upto``; returns the traces skipped as live.

        What is skipped is found again when it is read, so read it before the next write.  The deletion is one append, and an audit row follows it.
        """
        planned = self.retention_plan(request, cutoff)
        batches = self.events().withColumn("_arrival", F.col("_arrival.batch"))
        rows, skipped = rt.apply(planned, batches, upto)
        self._append("deletes", rows.select("trace_id").distinct().withColumn("upto", F.lit(upto).cast("long")))
        now = time.time_ns()
        gone = self.table("deletes").where(F.col("upto") == upto)
        self._append("audits", rt.audit(gone, source, now).withColumn("id", F.lit(now)))
        return skipped

    def retention_audit(
        self, id: int | None = None, source: str | None = None, created_from: int | None = None, created_to: int | None = None, cursor: int = 0, limit: int | None = None
    ) -> DataFrame:
        """Audit rows, newest first."""
        found = self.table("audits")
        for c, v in (("id", id), ("source", source)):
            if v is not None:
                found = found.where(F.col(c) == v)
        if created_from is not None:
            found = found.where(F.col("created_at") >= created_from)
        if created_to is not None:
            found = found.where(F.col("created_at") <= created_to)
        return page(found, md.newest(found), cursor, limit)

    # retention policies: versions of one row a policy, the latest counts

    def _write_policies(self, policies: Sequence[rt.Policy], version: int) -> None:
        rows = [
            (p.id, version, p.name, p.interval, json.dumps({k: v for k, v in p.query.items() if k not in ("cutoff", "ttl")}), p.query.get("cutoff"), p.query.get("ttl"), p.enabled, p.next_run, version)
            for p in policies
        ]
        if rows:
            self._append("policies", self.spark.createDataFrame(rows, TABLES["policies"]))

    def put_policy(self, policy: rt.Policy) -> None:
        """Add a policy or replace the one of its id."""
        self._write_policies([policy], time.time_ns())

    def policies(self, cursor: int = 0, limit: int | None = None) -> DataFrame:
        return page(md.latest(self.table("policies")), [F.col("id")], cursor, limit)

    def run_due_policies(self, now: int, limit: int = 100) -> list[rt.Policy]:
        """Run what is due, oldest first, and store the next runs; at most 100 policies come to the driver."""
        due = []
        for r in rt.due_rows(md.latest(self.table("policies")), now, limit).collect():
            limits = {k: v for k, v in (("cutoff", r["cutoff"]), ("ttl", r["ttl"])) if v is not None}
            due.append(rt.Policy(r["id"], r["name"], r["every"], json.loads(r["request"]) | limits, r["enabled"], r["next_run"]))

        def run(policy: rt.Policy, cutoff: int) -> None:
            request = {k: v for k, v in policy.query.items() if k not in ("cutoff", "ttl")}
            self.retention_apply(time.time_ns(), request, cutoff, f"policy:{policy.id}")

        done = rt.run_due(due, now, run, limit)
        self._write_policies(done, time.time_ns())
        return done
