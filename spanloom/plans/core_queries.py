"""Registered queries over the trace tables: fold, filters, roll-ups, trees, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.labels import attr_label
from ..operators import fold as fo, readmodels as rm, trajectory as tj
from ..operators.predicates import SearchFilter, attr_matches, page
from ..schema import SCALARS
from ..sources import tables

PLAIN = [c for c in SCALARS if c not in ("external_span_id", "external_parent_span_id", "external_session_id", "span_name", "display_name", "eval_score", "eval_label")]

#: The same adapter and fold in DuckDB; every oracle starts with these.
SPANS_SQL = f"""
WITH ev AS ({tables.for_duckdb(tables.EVENTS)}),
spans AS (
  SELECT trace_id, span_id, {", ".join(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in PLAIN)},
    {", ".join(f"arg_max({a}, seq) FILTER (WHERE {a} IS NOT NULL) AS {a}" for a in tables.ATTRS)},
    list(log ORDER BY seq) FILTER (WHERE log IS NOT NULL) AS all_logs,
    bool_or(event_type = 1) AS has_start, bool_or(event_type = 2) AS has_end, count(*) AS event_count, min(ts) AS min_ts, max(ts) AS max_ts
  FROM ev GROUP BY ALL
), folded AS (
  SELECT *, list_filter(coalesce(all_logs, []), lambda x, i: list_position(all_logs, x) = i) AS logs,
    coalesce(status <> 0, false) AS failed,
    CASE WHEN has_start AND has_end THEN 'completed' WHEN has_start THEN 'running' WHEN has_end THEN 'orphan_end' ELSE 'incomplete' END AS lifecycle,
    CASE WHEN status <> 0 THEN 'error' WHEN status = 0 OR (has_start AND has_end) THEN 'ok' WHEN has_start THEN 'run' ELSE 'incomplete' END AS label,
    trim(validation_status, '"') AS verdict, model IS NOT NULL OR input_tokens IS NOT NULL OR output_tokens IS NOT NULL OR cache_read_tokens IS NOT NULL OR cache_write_tokens IS NOT NULL AS llm
  FROM spans
)
"""
TOK = "CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens"
CACHE = (
    "CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(cache_read_tokens) AS cache_read_reported, "
    "CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, count(cache_write_tokens) AS cache_write_reported, count(*) FILTER (WHERE llm) AS total_llm_spans"
)
TOOK = "CAST(sum(duration_ns) AS BIGINT) AS total_duration_ns"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = SPANS_SQL):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = base + sql
        return f

    return register


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.fold(tables.trace_events(spark, sf_dir), unique=True)


@query(
    f"SELECT trace_id, span_id, {', '.join(PLAIN)}, array_to_string(logs, '|') AS logs, loop_id, task_fingerprint, validation_status, "
    "has_start, has_end, event_count, min_ts, max_ts, lifecycle, label FROM folded"
)
def fold_spans(spark, d):
    s = folded(spark, d)
    return s.select(
        "trace_id", "span_id", *PLAIN, F.array_join("logs", "|").alias("logs"), *[F.col("attrs")[a].alias(a) for a in tables.ATTRS],
        "has_start", "has_end", "event_count", "min_ts", "max_ts", fo.lifecycle().alias("lifecycle"), fo.status_label().alias("label"),
    )


@query("SELECT trace_id, span_id, status, duration_ns, event_count FROM folded")
def fold_deduplicated(spark, d):
    """Every third event arrives twice; the fold counts each identity once."""
    ev = tables.trace_events(spark, d)
    again = ev.where("(trace_id + seq) % 3 = 0").withColumn("_arrival", F.col("_arrival") + 1000)
    return fo.fold(ev.unionByName(again)).select("trace_id", "span_id", "status", "duration_ns", "event_count")


@query(
    "SELECT trace_id, span_id, CASE WHEN span_id = 2 THEN 'late' ELSE model END AS model, status FROM folded"
)
def fold_with_patches(spark, d):
    """A late patch names the model of every second span."""
    s = folded(spark, d)
    late = tables.trace_events(spark, d).where("span_id = 2 AND seq = 1").select("trace_id", "span_id", F.lit("late").alias("model"), F.lit(1).alias("segment_id"))
    return fo.overlay(s, late).select("trace_id", "span_id", "model", "status")


@query("SELECT trace_id, span_id, model FROM folded WHERE model = 'model-2'")
def two_phase_read(spark, d):
    """Candidate keys from narrow columns first, then the fold of their events alone."""
    ev = tables.trace_events(spark, d)
    narrow = fo.fold(ev.select("trace_id", "span_id", "ext_span_id", "seq", "event_type", "_arrival", "model"), unique=True)
    keys = narrow.where("model = 'model-2'").select("trace_id", "span_id")
    return fo.fold(fo.candidate_events(ev, keys), unique=True).select("trace_id", "span_id", "model")


@query(
    f"SELECT trace_id, count(*) AS span_count, {TOOK}, max(duration_ns) AS max_duration_ns, count(*) FILTER (WHERE failed) AS error_count, {TOK}, {CACHE}, "
    "arg_min(external_trace_id, span_id) FILTER (WHERE external_trace_id IS NOT NULL) AS external_trace_id FROM folded GROUP BY trace_id"
)
def list_traces(spark, d):
    return rm.list_traces(folded(spark, d))


@query(f"SELECT session_id, count(DISTINCT trace_id) AS trace_count, count(*) AS span_count, {TOK}, {CACHE} FROM folded WHERE session_id IS NOT NULL GROUP BY session_id")
def list_sessions(spark, d):
    return rm.list_sessions(folded(spark, d))


@query(f"SELECT agent_name, count(*) AS span_count, {TOK}, {CACHE} FROM folded WHERE agent_name IS NOT NULL GROUP BY agent_name")
def cost_by_agent(spark, d):
    return rm.cost_by_agent(folded(spark, d))


_SESSIONS = (
    "SELECT session_id, CAST(NULL AS VARCHAR) AS external_session_id, coalesce(arg_min(agent_name, trace_id * 1000 + span_id) FILTER (WHERE agent_name IS NOT NULL), '会话 ' || session_id) AS title, "
    f"count(DISTINCT trace_id) AS turn_count, {TOK}, {CACHE}, bool_or(label = 'error') AS has_error, bool_or(label = 'run') AS has_running, min(trace_id) AS first_trace FROM "
)


@query(_SESSIONS + "folded WHERE session_id IS NOT NULL GROUP BY session_id")
def console_sessions(spark, d):
    return rm.console_sessions(folded(spark, d))


@query(_SESSIONS + "folded WHERE session_id IN (SELECT session_id FROM folded WHERE tool_name = 'tool-4' AND tenant_id = 2) GROUP BY session_id")
def console_sessions_matching(spark, d):
    return rm.console_sessions(folded(spark, d), (F.col("tool_name") == "tool-4") & (F.col("tenant_id") == 2))


@query(
    f"SELECT session_id, title, turn_count, round(input_tokens * 8e-7 + output_tokens * 4e-6, 3) AS cost, started_at FROM (SELECT *, session_id AS started_at FROM ({_SESSIONS} folded WHERE session_id IS NOT NULL GROUP BY session_id)) "
    "WHERE contains(title, 'MACH') OR contains(CAST(session_id AS VARCHAR), 'MACH') ORDER BY session_id DESC LIMIT 50 OFFSET 10"
)
def sessions_page(spark, d):
    s = rm.sessions_page(rm.console_sessions(folded(spark, d)), "MACH").select("session_id", "title", "turn_count", "cost", "started_at")
    return page(s, [F.col("session_id").desc()], 10)


_AGG = (
    "count(*) AS span_count, count(DISTINCT trace_id) AS trace_count, count(*) FILTER (WHERE failed) AS error_count, CAST(coalesce(sum(duration_ns), 0) AS BIGINT) AS total_duration_ns, "
    f"coalesce(max(duration_ns), 0) AS max_duration_ns, {TOK}, {CACHE} FROM folded"
)
_AGENT = "coalesce('\"' || agent_name || '\"', 'null')"


@query(f"SELECT {_AGENT} AS key_0, coalesce(CAST(status AS VARCHAR), 'null') AS key_1, {_AGG} GROUP BY 1, 2")
def trace_aggregate_fields(spark, d):
    return rm.trace_aggregate(folded(spark, d), ["agent", "status"])


@query(f"SELECT coalesce(loop_id, 'null') AS key_0, {_AGG} WHERE tenant_id = 1 GROUP BY 1 ORDER BY span_count DESC, key_0 LIMIT 50")
def trace_aggregate_attr(spark, d):
    return rm.aggregate_page(rm.trace_aggregate(folded(spark, d), ["loop_id"], F.col("tenant_id") == 1))


@query(
    f"SELECT {_AGENT} AS key_0, count(DISTINCT trace_id) AS trace_count, count(*) AS span_count, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(96 + "
    + " + ".join(f"coalesce(strlen({c}), 0)" for c in ("external_trace_id", "agent_name", "tool_name", "model", "input_text", "output_text"))
    + " + coalesce(list_sum(list_transform(logs, lambda x: strlen(x))), 0)"
    + "".join(f" + coalesce(strlen({a}) + {len(a)}, 0)" for a in tables.ATTRS)
    + ") AS BIGINT) AS estimated_bytes FROM folded GROUP BY 1"
)
def storage_stats(spark, d):
    return rm.storage_stats(folded(spark, d), ["agent_name"])


_ITEM = "trace_id, span_id, status, duration_ns, input_tokens, output_tokens"


def _search(spark, d, f: SearchFilter, sort=None, cursor=0, limit=None):
    return rm.trace_search(folded(spark, d), f.column(), sort, cursor, limit).select(*_ITEM.split(", "), "total")


def _search_sql(where: str, order: str, limit: int = 50, offset: int = 0) -> str:
    return f"SELECT {_ITEM}, (SELECT count(*) FROM folded WHERE {where}) AS total FROM folded WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


@query(_search_sql("tenant_id = 1 AND agent_name = 'BUILDING'", "trace_id, span_id", 40, 20))
def trace_search_default(spark, d):
    return _search(spark, d, SearchFilter(tenant_id=1, agent_name="BUILDING"), None, 20, 40)


@query(_search_sql("model = 'model-1'", "duration_ns DESC NULLS LAST, trace_id, span_id"))
def trace_search_duration(spark, d):
    return _search(spark, d, SearchFilter(model="model-1"), "duration")


@query(_search_sql("tool_name = 'tool-2' AND loop_id = '\"loop-7\"'", "coalesce(input_tokens, 0) + coalesce(output_tokens, 0) DESC, trace_id, span_id", 500))
def trace_search_tokens(spark, d):
    return _search(spark, d, SearchFilter(tool_name="tool-2", attrs={"loop_id": '"loop-7"'}), "tokens", 0, 1000)


_DAY = 86_400_000_000_000
_FROM, _TO = 9_500 * _DAY, 9_900 * _DAY


@query(_search_sql(f"max_ts >= {_FROM} AND min_ts <= {_TO} AND status = 1", "coalesce(status, 0) DESC, trace_id, span_id", 100))
def trace_search_time_overlap(spark, d):
    return _search(spark, d, SearchFilter(time_from=_FROM, time_to=_TO, status=1), "status", 0, 100)


@query(
    _search_sql(
        "coalesce(contains(input_text, 'part 1'), false) OR coalesce(contains(output_text, 'part 1'), false) OR len(list_filter(logs, lambda x: contains(x, 'part 1'))) > 0",
        "trace_id, span_id",
    )
)
def trace_search_text(spark, d):
    return _search(spark, d, SearchFilter(text="part 1"))


@query(f"SELECT {_ITEM} FROM folded WHERE external_trace_id = 'order-7'")
def external_trace_lookup(spark, d):
    return folded(spark, d).where(SearchFilter(external_trace_id="order-7").column()).select(*_ITEM.split(", "))


@query("SELECT trace_id, span_id, ts, seq, event_type, ext_span_id, log AS logs FROM ev WHERE log IS NOT NULL")
def log_events(spark, d):
    return rm.log_events(tables.trace_events(spark, d), unique=True).drop("event_id", "place").withColumn("logs", F.array_join("logs", "|"))


@query(
    "SELECT trace_id, span_id, seq, log AS logs, rank() OVER (PARTITION BY trace_id ORDER BY ts, seq) - 1 AS first_place FROM ev WHERE log IS NOT NULL"
)
def log_event_places(spark, d):
    """Every third event arrives twice; each log event has one place in its trace, those of one time and sequence next to each other."""
    ev = tables.trace_events(spark, d)
    again = ev.where("(trace_id + seq) % 3 = 0").withColumn("_arrival", F.col("_arrival") + 1000)
    found = rm.log_events(ev.unionByName(again))
    first = F.min("place").over(Window.partitionBy("trace_id", "ts", "seq"))
    return found.select("trace_id", "span_id", "seq", F.array_join("logs", "|").alias("logs"), first.alias("first_place"))


@query(
    "SELECT trace_id, span_id, CAST(coalesce(sum(coalesce(duration_ns, 0)) OVER (PARTITION BY trace_id ORDER BY span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_start_ns FROM folded"
)
def waterfall(spark, d):
    return rm.waterfall(folded(spark, d)).select("trace_id", "span_id", "logical_start_ns")


_KIND = "CASE WHEN tool_name IS NOT NULL THEN 'tool' WHEN agent_name IS NOT NULL THEN 'agent' WHEN model IS NOT NULL THEN 'llm' ELSE 'other' END"


@query(
    f"SELECT trace_id, span_id, {_KIND} AS kind, coalesce('tool:' || tool_name, 'agent:' || agent_name, 'model:' || model, 'span:' || span_id) AS actor, "
    "coalesce(tool_name, agent_name, model, 'span-' || span_id) AS name, label, duration_ns, input_text, output_text FROM folded WHERE trace_id % 10 = 3"
)
def trace_detail(spark, d):
    return rm.trace_detail(folded(spark, d).where("trace_id % 10 = 3")).select("trace_id", "span_id", "kind", "actor", "name", "label", "duration_ns", "input_text", "output_text")


@query(
    f"SELECT trace_id, span_id, {_KIND} AS kind, coalesce('tool:' || tool_name, 'agent:' || agent_name, 'model:' || model, 'span:' || span_id) AS actor, "
    "coalesce(tool_name, agent_name, model, 'span-' || span_id) AS name, label, duration_ns, input_text, output_text FROM folded"
)
def trace_detail_all(spark, d):
    """Every trace, where ``trace_detail`` reads one in ten."""
    return rm.trace_detail(folded(spark, d)).select("trace_id", "span_id", "kind", "actor", "name", "label", "duration_ns", "input_text", "output_text")


@query(
    "SELECT trace_id, CASE max(CASE label WHEN 'error' THEN 3 WHEN 'run' THEN 2 WHEN 'incomplete' THEN 1 ELSE 0 END) WHEN 3 THEN 'error' WHEN 2 THEN 'run' WHEN 1 THEN 'incomplete' ELSE 'ok' END AS status, "
    f"count(*) AS span_count, {TOOK}, max(duration_ns) AS max_duration_ns, {TOK} FROM folded GROUP BY trace_id"
)
def trace_summaries(spark, d):
    return rm.trace_summaries(folded(spark, d))


@query("SELECT f.span_id, input_text, output_text, label, (SELECT string_agg(log, '|' ORDER BY ts, seq) FROM ev e WHERE e.trace_id = 7 AND e.span_id = f.span_id) AS logs FROM folded f WHERE trace_id = 7 AND span_id = 2")
def span_detail(spark, d):
    s = folded(spark, d).where("trace_id = 7 AND span_id = 2")
    raw = rm.log_events(tables.trace_events(spark, d).where("trace_id = 7 AND span_id = 2"), unique=True)
    logs = raw.groupBy("trace_id", "span_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "logs"))).alias("l"))
    logs = logs.select("trace_id", "span_id", F.array_join(F.flatten(F.transform("l", lambda x: x["logs"])), "|").alias("all_logs"))
    return s.withColumn("label", fo.status_label()).join(logs, ["trace_id", "span_id"], "left").select("span_id", "input_text", "output_text", "label", F.col("all_logs").alias("logs"))


_TIMELINE = (
    "SELECT session_id, trace_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY trace_id) - 1 AS BIGINT) AS turn, * EXCLUDE (session_id, trace_id) FROM (SELECT session_id, trace_id, "
    "arg_min(input_text, span_id) FILTER (WHERE input_text IS NOT NULL) AS input_text, arg_max(output_text, span_id) FILTER (WHERE output_text IS NOT NULL) AS answer, "
    "coalesce(array_to_string(list_sort(list(DISTINCT agent_name) FILTER (WHERE agent_name IS NOT NULL)), '|'), '') AS agents, count(*) AS span_count, count(*) FILTER (WHERE failed) AS error_count, "
    f"CAST(sum(coalesce(duration_ns, 0)) AS BIGINT) AS total_duration_ns, {TOK} FROM folded WHERE session_id IS NOT NULL GROUP BY session_id, trace_id)"
)


@query(_TIMELINE)
def session_timeline(spark, d):
    return rm.session_timeline(folded(spark, d), tables.parts(spark, d)).drop("eval_score").withColumn("agents", F.array_join("agents", "|"))


@query(
    "SELECT session_id, turn, trace_id, coalesce(CASE WHEN length(input_text) > 40 THEN left(input_text, 40) || '…' ELSE input_text END, '第' || (turn + 1) || '轮') AS name, "
    f"total_duration_ns // 1000000 AS dur_ms, CASE WHEN error_count > 0 THEN 'error' ELSE 'ok' END AS status FROM ({_TIMELINE})"
)
def turns(spark, d):
    return rm.turns(rm.session_timeline(folded(spark, d), tables.parts(spark, d)))


@query(
    "SELECT session_id, trace_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY trace_id) - 1 AS BIGINT) AS turn, input_text, answer FROM (SELECT session_id, trace_id, "
    "arg_min(input_text, span_id) FILTER (WHERE input_text IS NOT NULL) AS input_text, arg_max(output_text, span_id) FILTER (WHERE output_text IS NOT NULL) AS answer FROM chat GROUP BY ALL)",
    base=f"WITH chat AS ({tables.CHAT}) ",
)
def conversation_turns(spark, d):
    s = fo.fold(
        tables.chat_spans(spark, d).select(
            "trace_id", "span_id", "session_id", "input_text", "output_text", F.lit(1).cast("long").alias("seq"), F.lit(1).alias("event_type"),
            F.concat_ws("-", "session_id", "span_id").alias("ext_span_id"),
        ),
        unique=True,
    )
    return rm.session_timeline(s).select("session_id", "trace_id", "turn", "input_text", "answer")


_TREE = "SELECT c.*, p.span_id IS NOT NULL AS found FROM folded c LEFT JOIN folded p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id"


@query(f"SELECT trace_id, CASE WHEN found THEN parent_span_id END AS parent, string_agg(span_id, ',' ORDER BY span_id) AS children FROM ({_TREE}) GROUP BY 1, 2")
def trace_tree(spark, d):
    return tj.trace_tree(folded(spark, d)).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


_DEPTH = """, walk AS (
  SELECT c.trace_id, c.span_id, CASE WHEN c.parent_span_id IS NULL THEN 0 ELSE 1 END AS depth, lpad(CAST(c.span_id AS VARCHAR), 9, '0') AS path
  FROM folded c WHERE c.parent_span_id IS NULL OR NOT EXISTS (SELECT 1 FROM folded p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)
  UNION ALL
  SELECT c.trace_id, c.span_id, w.depth + 1, w.path || '/' || lpad(CAST(c.span_id AS VARCHAR), 9, '0') FROM folded c JOIN walk w ON w.trace_id = c.trace_id AND w.span_id = c.parent_span_id WHERE w.depth < 65
)
"""
RECURSIVE = SPANS_SQL.replace("WITH ev", "WITH RECURSIVE ev", 1) + _DEPTH


@query("SELECT trace_id, span_id, CAST(depth AS BIGINT) AS depth FROM walk", base=RECURSIVE)
def span_depth(spark, d):
    return tj.depths(folded(spark, d))


@query("SELECT trace_id, span_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS BIGINT) AS place FROM walk", base=RECURSIVE)
def depth_first_order(spark, d):
    return tj.depth_first(folded(spark, d))


@query(
    "SELECT trace_id, span_id, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY trace_id ORDER BY depth, span_id) - 1 AS place, label, input_text, output_text FROM folded JOIN walk USING (trace_id, span_id)",
    base=RECURSIVE,
)
def trace_steps(spark, d):
    return rm.trace_steps(folded(spark, d)).select("trace_id", "span_id", "depth", "place", "label", "input_text", "output_text")


@query(
    "SELECT trace_id, span_id, CASE WHEN span_id = 1 THEN 'late agent' ELSE agent_name END AS agent_name, CASE WHEN span_id = 1 THEN 7 ELSE duration_ns END AS duration_ns, "
    "array_to_string(CASE WHEN span_id = 1 THEN list_concat(logs, ['late log']) ELSE logs END, '|') AS logs, CASE WHEN span_id = 1 THEN '\"late\"' ELSE loop_id END AS loop_id, validation_status FROM folded"
)
def fold_with_late_fields(spark, d):
    """Late patches of names, numbers, logs and attributes; of two patches the later segment's wins."""
    first = tables.trace_events(spark, d).where("span_id = 1 AND seq = 1").select("trace_id", "span_id")
    late = first.select(
        "*", F.lit("late agent").alias("agent_name"), F.lit(7).cast("long").alias("duration_ns"), F.array(F.lit("late log")).alias("logs"),
        F.create_map(F.lit("loop_id"), F.lit('"late"')).alias("attrs"), F.lit(2).alias("segment_id"),
    )
    early = late.withColumns({"agent_name": F.lit("early"), "attrs": F.create_map(F.lit("loop_id"), F.lit('"early"')), "segment_id": F.lit(1)})
    s = fo.overlay(folded(spark, d), late.unionByName(early))
    return s.select("trace_id", "span_id", "agent_name", "duration_ns", F.array_join("logs", "|").alias("logs"), F.col("attrs")["loop_id"].alias("loop_id"), F.col("attrs")["validation_status"].alias("validation_status"))


@query("SELECT doc_id % 7 AS trace_id, doc_id AS span_id, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) - 1 AS place FROM documents", base="")
def deep_trace(spark, d):
    """Chains as long as a seventh of the documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    up = F.lag("doc_id").over(Window.partitionBy(F.col("doc_id") % 7).orderBy("doc_id"))
    return tj.depth_first(docs.select((F.col("doc_id") % 7).alias("trace_id"), F.col("doc_id").alias("span_id"), up.alias("parent_span_id")))


_PATHS = """, paths AS (
  SELECT trace_id, count(*) AS span_count, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(coalesce(duration_ns, 0)) AS BIGINT) AS total_duration_ns,
    """ + TOK + """, bool_or(failed) AS has_error, NOT bool_or(failed OR coalesce(verdict IN ('fail', 'failed', 'error'), false)) AS success, max(session_id) AS session_id,
    string_agg(step, '>' ORDER BY depth, span_id) AS signature, list(step ORDER BY depth, span_id) AS steps
  FROM (SELECT f.*, depth, CASE WHEN tool_name IS NOT NULL THEN 'tool' WHEN model IS NOT NULL THEN 'llm' WHEN agent_name IS NOT NULL THEN 'agent' ELSE 'span' END || '|' ||
      coalesce(tool_name, agent_name, model, logs[1], 'span-' || f.span_id) || '|' || coalesce(tool_name, '') || '|' || coalesce(model, '') || '|' || coalesce(CAST(status AS VARCHAR), '') AS step
    FROM folded f JOIN walk USING (trace_id, span_id))
  GROUP BY trace_id
)
"""


@query("SELECT * EXCLUDE (steps), CASE WHEN has_error THEN 'error' ELSE 'ok' END AS status FROM paths", base=RECURSIVE + _PATHS)
def trace_trajectories(spark, d):
    return tj.trajectories(folded(spark, d)).select(
        "trace_id", "span_count", "event_count", "total_duration_ns", "input_tokens", "output_tokens", "has_error", "success", "session_id", "signature", "status"
    )


@query(
    "SELECT signature, count(*) AS trace_count, CAST(sum(span_count) AS BIGINT) AS span_count, count(*) FILTER (WHERE success) AS success_count, count(*) FILTER (WHERE has_error) AS error_count, "
    "CAST(sum(total_duration_ns) AS BIGINT) AS total_duration_ns, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
    "array_to_string(list_sort(list(trace_id))[1:3], ',') AS examples FROM paths GROUP BY signature ORDER BY trace_count DESC, success_count DESC, signature LIMIT 100",
    base=RECURSIVE + _PATHS,
)
def trajectory_groups(spark, d):
    g = tj.groups_page(tj.trajectory_groups(tj.trajectories(folded(spark, d))), limit=100)
    return g.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(
    """SELECT b.signature = c.signature AS same_signature, n AS common_prefix, coalesce(array_to_string(b.steps[n + 1:], '>'), '') AS missing, coalesce(array_to_string(c.steps[n + 1:], '>'), '') AS extra,
      c.total_duration_ns - b.total_duration_ns AS delta_total_duration_ns, c.input_tokens - b.input_tokens AS delta_input_tokens, c.output_tokens - b.output_tokens AS delta_output_tokens, c.span_count - b.span_count AS delta_span_count
    FROM (SELECT * FROM paths WHERE trace_id = 3) b, (SELECT * FROM paths WHERE trace_id = 7) c,
      LATERAL (SELECT coalesce(min(i) - 1, least(len(b.steps), len(c.steps))) AS n FROM (SELECT unnest(range(1, least(len(b.steps), len(c.steps)) + 1)) AS i) WHERE b.steps[i] <> c.steps[i])""",
    base=RECURSIVE + _PATHS,
)
def trace_diff(spark, d):
    two = folded(spark, d).where("trace_id IN (3, 7)")
    return tj.trace_diff(tj.trajectories(two), 3, 7)


_ACTOR = "coalesce(tool_name, agent_name, 'span:' || span_id)"


@query(
    f"SELECT trace_id, {_ACTOR} AS actor, arg_min(CASE WHEN tool_name IS NOT NULL THEN 'tool' WHEN agent_name IS NOT NULL THEN 'agent' ELSE 'other' END, span_id) AS kind, count(*) AS span_count, {TOK}, {CACHE} FROM folded GROUP BY 1, 2"
)
def agent_graph_nodes(spark, d):
    return tj.agent_nodes(folded(spark, d))


@query(
    f"SELECT c.trace_id, p.actor AS source, c.actor AS target, count(*) AS calls FROM (SELECT *, {_ACTOR} AS actor FROM folded) c JOIN (SELECT *, {_ACTOR} AS actor FROM folded) p "
    "ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.actor <> c.actor GROUP BY ALL"
)
def agent_graph_edges(spark, d):
    return tj.agent_edges(folded(spark, d))


_CONSOLE_ACTOR = "coalesce('tool:' || tool_name, 'agent:' || agent_name, 'model:' || model, 'span:' || span_id)"


@query(f"SELECT trace_id, {_CONSOLE_ACTOR} AS actor, count(*) AS span_count, {TOK} FROM folded GROUP BY 1, 2")
def console_graph_nodes(spark, d):
    return tj.agent_nodes(folded(spark, d), "console").select("trace_id", "actor", "span_count", "input_tokens", "output_tokens")


_LOOP = (
    f"SELECT trim(loop_id, '\"') AS loop, count(DISTINCT trace_id) AS trace_count, count(*) AS span_count, count(*) FILTER (WHERE failed) AS error_count, CAST(sum(coalesce(duration_ns, 0)) AS BIGINT) AS total_duration_ns, {TOK}, {CACHE}, "
    "CAST(NULL AS VARCHAR) AS project, arg_min(trim(task_fingerprint, '\"'), trace_id * 1000 + span_id) FILTER (WHERE task_fingerprint IS NOT NULL) AS task, arg_min(verdict, trace_id * 1000 + span_id) FILTER (WHERE verdict IS NOT NULL) AS validation FROM folded WHERE loop_id IS NOT NULL "
)


@query(_LOOP + "GROUP BY 1")
def loops(spark, d):
    return rm.loops(folded(spark, d))


@query(_LOOP + "AND loop_id = '\"loop-7\"' GROUP BY 1")
def loop_detail(spark, d):
    return rm.loops(folded(spark, d).where(attr_matches("loop_id", "loop-7")))


@query("SELECT trace_id, signature FROM paths WHERE trace_id IN (SELECT trace_id FROM folded WHERE loop_id = '\"loop-7\"')", base=RECURSIVE + _PATHS)
def loop_trajectories(spark, d):
    s = rm.spans_of_matching_traces(folded(spark, d), attr_matches("loop_id", "loop-7"))
    return tj.trajectories(s).select("trace_id", "signature")


@query(
    "SELECT trace_id FROM folded GROUP BY trace_id HAVING bool_or(coalesce(trim(task_fingerprint, '\"') = 'task-3', false)) AND bool_or(coalesce(verdict = 'pass', false))"
)
def task_traces(spark, d):
    return rm.task_traces(folded(spark, d), "task-3", {"validation_status": "pass"})


@query("SELECT trace_id, min(ts) AS min_ts, max(ts) AS max_ts FROM ev GROUP BY trace_id")
def trace_time_bounds(spark, d):
    return tables.trace_events(spark, d).groupBy("trace_id").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


@query("SELECT trim(validation_status, '\"') AS verdict, count(*) AS n FROM folded GROUP BY 1")
def attr_labels(spark, d):
    return folded(spark, d).groupBy(attr_label(F.col("attrs")["validation_status"]).alias("verdict")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession) -> DataFrame:
    return list_traces(spark, "/root/testdata/sf0.001")
