"""Registered queries: search, vectors, evaluation, metadata, retention, parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..ids import numeric_id
from ..operators import evaluate as ev, metadata as md, retention as rt, search as se
from ..operators.predicates import page
from ..schema import START
from ..sources import otlp, tables, wire
from .core_queries import SPANS_SQL, folded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_BM25 = f"""
WITH cut AS (SELECT doc_id, lang, {_WORDS} AS t FROM documents),
tf AS (SELECT doc_id, lang, len(t) AS dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS f FROM cut, (SELECT unnest(['apache', 'license', 'the', 'under']) AS term) q),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM cut), df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY term),
scored AS (SELECT doc_id, lang, sum(CASE WHEN f > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM tf JOIN df USING (term), stats GROUP BY ALL)
"""
TEXT = "under the Apache license"


@query(_BM25 + "SELECT doc_id, round(score, 4) AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, doc_id LIMIT 50")
def bm25_search(spark, d):
    return se.bm25(_table(spark, d, "documents"), TEXT, ["doc_id"], 50).withColumn("score", F.round("score", 4))


@query(_BM25 + "SELECT doc_id, round(score, 4) AS score FROM scored WHERE score > 0 AND lang = 'de' ORDER BY scored.score DESC, doc_id LIMIT 20")
def bm25_filtered(spark, d):
    return se.bm25(_table(spark, d, "documents"), TEXT, ["doc_id"], 20, matching=F.col("lang") == "de").withColumn("score", F.round("score", 4))


@query(_BM25 + "SELECT doc_id, round(score, 4) AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, doc_id LIMIT 50")
def bm25_postings(spark, d):
    """The same search from a postings table."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    posted = se.postings(docs, ["doc_id"])
    lengths = docs.select("doc_id", F.size(tokens(F.col("text"))).alias("doc_len"))
    return se.bm25_from_postings(posted, lengths, TEXT, ["doc_id"], 50).withColumn("score", F.round("score", 4))


@query(f"SELECT w AS token, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY 1")
def tokenized_terms(spark, d):
    return _table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT w AS token, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY 1")
def tokenized_document_terms(spark, d):
    """All documents, where ``tokenized_terms`` reads the benchmark."""
    return _table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(
    SPANS_SQL
    + """, doc AS (SELECT trace_id, span_id, regexp_extract_all(lower(string_agg(concat_ws(' ', input_text, output_text, agent_name, tool_name, model, log), ' ' ORDER BY seq)), '[\\p{L}\\p{N}]+') AS t FROM ev GROUP BY ALL),
    tf AS (SELECT trace_id, span_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM doc, (SELECT unnest(['refused', 'machinery']) AS term)),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM doc), df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY term),
    scored AS (SELECT trace_id, span_id, sum(CASE WHEN f > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM tf JOIN df USING (term), stats GROUP BY ALL)
    SELECT trace_id, span_id, round(score, 4) AS score, status, model FROM (SELECT * FROM scored WHERE score > 0 ORDER BY round(score, 9) DESC, trace_id, span_id LIMIT 25) JOIN folded USING (trace_id, span_id)"""
)
def span_text_search(spark, d):
    """Full-text search over spans' events, hits joined to folded spans."""
    docs = se.span_documents(tables.trace_events(spark, d))
    hits = se.bm25(docs, "refused machinery", ["trace_id", "span_id"], None)
    hits = hits.orderBy(F.round("score", 9).desc(), "trace_id", "span_id").limit(25)
    return se.materialize(hits, folded(spark, d), ["trace_id", "span_id"]).select("trace_id", "span_id", F.round("score", 4).alias("score"), "status", "model")


#: The query vector of the registered searches.
PROBE = [((i * 37) % 64 - 31.5) / 256 for i in range(64)]
_VECTOR = "[" + ", ".join(map(repr, PROBE)) + "]"
_V = f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, {_VECTOR}::DOUBLE[] AS q FROM embeddings), "
_U = "u AS (SELECT vec_id, label, list_transform(x, lambda a: a / sqrt(list_inner_product(x, x))) AS x, list_transform(q, lambda a: a / sqrt(list_inner_product(q, q))) AS q FROM v) "


def _knn(spark, d, k, metric, matching=None):
    found = se.knn(_table(spark, d, "embeddings"), PROBE, ["vec_id"], k, metric=metric, matching=matching)
    return found.withColumn("distance", F.round("distance", 4))


@query(_V + "u AS (SELECT * FROM v) SELECT vec_id, round(list_distance(x, q), 4) AS distance FROM u ORDER BY list_distance(x, q), vec_id LIMIT 10")
def knn_l2(spark, d):
    return _knn(spark, d, 10, "l2")


@query(_V + _U + "SELECT vec_id, round(list_distance(x, q), 4) AS distance FROM u ORDER BY list_distance(x, q), vec_id LIMIT 10")
def knn_cosine(spark, d):
    return _knn(spark, d, 10, "cosine")


@query(_V + "u AS (SELECT * FROM v) SELECT vec_id, round(-list_inner_product(x, q), 4) AS distance FROM u ORDER BY -list_inner_product(x, q), vec_id LIMIT 10")
def knn_inner_product(spark, d):
    return _knn(spark, d, 10, "ip")


@query(_V + "u AS (SELECT * FROM v) SELECT vec_id, round(list_distance(x, q), 4) AS distance FROM u WHERE label = 3 ORDER BY list_distance(x, q), vec_id LIMIT 10")
def knn_filtered(spark, d):
    return _knn(spark, d, 10, "l2", F.col("label") == 3)


@query(
    _BM25
    + f""", t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored WHERE score > 0 QUALIFY r <= 10),
    w AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_VECTOR}::DOUBLE[]), vec_id) AS r FROM embeddings QUALIFY r <= 10)
    SELECT id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM w) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10"""
)
def hybrid_search(spark, d):
    text = se.bm25(_table(spark, d, "documents"), TEXT, ["doc_id"], None).withColumn("score", F.round("score", 9))
    text = text.orderBy(F.col("score").desc(), "doc_id").limit(10).withColumnRenamed("doc_id", "id")
    near = se.knn(_table(spark, d, "embeddings"), PROBE, ["vec_id"], 10).withColumnRenamed("vec_id", "id")
    return se.hybrid(text, near, ["id"], 10).withColumn("score", F.round("score", 6))


@query()
def approximate_knn(spark, d, probe=PROBE):
    """Cells of a sampled codebook; the tests measure the recall of this very query for other probes."""
    vectors = _table(spark, d, "embeddings")
    index = se.InvertedFile.fit(vectors)
    return index.search(index.index(vectors), probe, ["vec_id"], 10)


_SCORED = SPANS_SQL + ", scored AS (SELECT trace_id, span_id, agent_name, CASE WHEN contains(output_text, 'refused') THEN 0 ELSE 1000 END AS eval_score FROM folded WHERE output_text IS NOT NULL) "


def _scored(spark, d, words=("refused",)):
    return ev.evaluate(folded(spark, d), ev.keyword_score(words))


@query(_SCORED + "SELECT *, CASE eval_score WHEN 0 THEN '未通过' ELSE '通过' END AS eval_label FROM scored")
def eval_keyword(spark, d):
    return _scored(spark, d)


_SUMMARY = "count(*) AS scored, count(*) FILTER (WHERE eval_score >= 600) AS passed, CAST(coalesce(sum(eval_score) // count(*), 0) AS BIGINT) AS avg_score FROM scored"


@query(_SCORED + f"SELECT CAST(NULL AS VARCHAR) AS agent_name, {_SUMMARY} UNION ALL SELECT agent_name, {_SUMMARY} WHERE agent_name IS NOT NULL GROUP BY agent_name")
def eval_summary(spark, d):
    return ev.eval_summary(_scored(spark, d))


@query(SPANS_SQL + "SELECT trace_id, span_id, CASE WHEN contains(output_text, 'refused') THEN 0 ELSE CASE WHEN output_text IS NOT NULL THEN 1000 END END AS eval_score FROM folded")
def eval_writeback(spark, d):
    """Scores written back as late patches."""
    from ..operators.fold import overlay

    patches = _scored(spark, d).select("trace_id", "span_id", "eval_score", "eval_label", F.lit(1).alias("segment_id"))
    return overlay(folded(spark, d), patches).select("trace_id", "span_id", "eval_score")


@query(SPANS_SQL + "SELECT trace_id, span_id FROM folded WHERE contains(output_text, 'refused') AND tenant_id <> 1")
def dataset_collect(spark, d):
    """Failures collected into a dataset that has those of tenant 1 already."""
    spans = folded(spark, d)
    bad = F.col("output_text").contains("refused")
    have = ev.collect_into_dataset(None, spans, bad & (F.col("tenant_id") == 1))
    return ev.collect_into_dataset(have, spans, bad & F.col("tenant_id").isNotNull()).select("trace_id", "span_id")


@query(
    SPANS_SQL
    + "SELECT name, count(*) AS examples FROM (SELECT CASE WHEN tenant_id = 1 THEN 'one' ELSE 'others' END AS name FROM folded WHERE contains(output_text, 'refused')) GROUP BY name"
)
def dataset_list(spark, d):
    spans = folded(spark, d).where(F.col("output_text").contains("refused"))
    return ev.list_datasets(spans.withColumn("name", F.when(F.col("tenant_id") == 1, "one").otherwise("others")))


@query(_SCORED + f", frozen AS (SELECT * FROM scored SEMI JOIN (SELECT trace_id, span_id FROM folded WHERE tenant_id = 1) USING (trace_id, span_id)) SELECT CAST(NULL AS VARCHAR) AS agent_name, {_SUMMARY.replace('FROM scored', 'FROM frozen')} UNION ALL SELECT agent_name, {_SUMMARY.replace('FROM scored', 'FROM frozen')} WHERE agent_name IS NOT NULL GROUP BY agent_name")
def dataset_eval(spark, d):
    """Frozen examples of one tenant, scored without writing back."""
    examples = ev.collect_into_dataset(None, folded(spark, d), F.col("tenant_id") == 1)
    return ev.eval_summary(ev.evaluate(examples, ev.keyword_score(["refused"])))


@query("SELECT p_partkey AS id, p_size * 1000 AS next_run FROM part WHERE p_partkey % 3 > 0 AND p_size * 1000 <= 20000 ORDER BY next_run, id LIMIT 100")
def due_policies(spark, d):
    """Parts as policies: sizes say when they run next."""
    parts = _table(spark, d, "part")
    rows = parts.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1000).alias("next_run"), (F.col("p_partkey") % 3 > 0).alias("enabled"))
    return rt.due_rows(rows, 20_000, 100).select("id", "next_run")


_RANKING = (
    "WITH ranking AS (SELECT lang AS query, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank FROM documents), "
    "good AS (SELECT lang AS query, doc_id AS item, quality * 2 + toxic AS grade FROM documents JOIN labels USING (doc_id) WHERE quality * 2 + toxic > 0), "
    "hit AS (SELECT r.query, count(*) AS hits, min(rank) AS first, sum((2.0 ** grade - 1) / log2(rank + 1)) AS dcg FROM ranking r JOIN good g ON r.query = g.query AND r.item = g.item WHERE rank <= 10 GROUP BY r.query), "
    "ideal AS (SELECT query, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN (2.0 ** grade - 1) / log2(i + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS i FROM good) GROUP BY query) "
)


@query(_RANKING + "SELECT query, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM ideal LEFT JOIN hit USING (query)")
def retrieval_metrics(spark, d):
    from pyspark.sql import Window

    docs = _table(spark, d, "documents")
    order = Window.partitionBy("lang").orderBy(F.length("text").desc(), "doc_id")
    ranking = docs.select(F.col("lang").alias("query"), F.col("doc_id").alias("item"), F.row_number().over(order).alias("rank")).where("rank <= 50")
    grades = docs.join(_table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("item"), (F.col("quality") * 2 + F.col("toxic")).alias("grade"))
    return ev.retrieval_metrics(ranking, grades).select("query", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


_SESSIONS = f"""
WITH chat AS ({tables.CHAT}), turns AS (
  SELECT session_id, trace_id AS turn, arg_min(input_text, span_id) FILTER (WHERE input_text IS NOT NULL) AS input_text, arg_max(output_text, span_id) FILTER (WHERE output_text IS NOT NULL) AS answer FROM chat GROUP BY ALL
), marked AS (SELECT *, answer IS NULL OR contains(answer, 'ing th') AS failed FROM turns),
seq AS (SELECT *, failed AND coalesce(lag(failed) OVER (PARTITION BY session_id ORDER BY turn), false) AS again, input_text IS NOT NULL AND count(*) OVER (PARTITION BY session_id, input_text) > 1 AS repeated FROM marked),
judged AS (SELECT session_id, count(*) AS turns, count(*) FILTER (WHERE failed) AS failed_turns, NOT arg_max(failed, turn) AS resolved, bool_or(again OR repeated) AS looped FROM seq GROUP BY session_id),
labelled AS (SELECT *, CASE WHEN NOT resolved THEN 0 WHEN looped THEN 500 ELSE 1000 END AS score, CASE WHEN NOT resolved THEN '未解决' WHEN looped THEN '绕圈后解决' ELSE '一次到位' END AS label FROM judged)
"""


def _sessions(spark, d):
    chat = tables.chat_spans(spark, d)
    t = chat.groupBy("session_id", F.col("trace_id").alias("turn")).agg(
        F.min_by("input_text", F.when(F.col("input_text").isNotNull(), F.col("span_id"))).alias("input_text"),
        F.max_by("output_text", F.when(F.col("output_text").isNotNull(), F.col("span_id"))).alias("answer"),
        F.lit(0).alias("error_count"),
    )
    return ev.session_eval(t, ["ing th"])


@query(_SESSIONS + "SELECT * FROM labelled")
def session_eval(spark, d):
    return _sessions(spark, d)


@query(_SESSIONS + "SELECT label, count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns FROM labelled GROUP BY label")
def session_report(spark, d):
    return ev.session_report(_sessions(spark, d))


def _annotations(spark, d):
    """Labels as annotations: two versions each, toxic ones deleted in the second."""
    rows = _table(spark, d, "labels")
    first = rows.select(
        F.col("doc_id").alias("id"), F.lit(1).alias("version"), (F.col("doc_id") % 3).alias("tenant_id"), F.col("doc_id").alias("trace_id"), F.lit("active").alias("status"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"), (F.col("doc_id") * 7 % 101).alias("created_at"),
        F.create_map(F.lit("grade"), F.concat(F.lit('"'), F.col("quality").cast("string"), F.lit('"'))).alias("attrs"),
    )
    toxic = rows.where("toxic = 1").select(F.col("doc_id").alias("id"))
    return first.unionByName(md.soft_delete(first, toxic))


def _associations(spark, d):
    items = _table(spark, d, "benchmark")
    flag = lambda n, v: F.when(F.col("item_id") % n == 0, v)
    return items.select(
        F.col("item_id").alias("id"), (F.col("item_id") * 2 + 1).alias("trace_id"), F.lit("golden").alias("dataset"), flag(3, "snap").alias("snapshot_id"), F.lit(None).cast("string").alias("snapshot_hash"),
        flag(4, "run-1").alias("eval_run_id"), F.when(F.col("item_id") % 5 == 0, F.create_map(F.lit("path_memory_id"), F.lit('"p"'))).otherwise(F.create_map(F.lit("x"), F.lit("1"))).alias("attrs"),
        (F.col("item_id") % 10).alias("created_at"),
    )


_NOTES = "WITH notes AS (SELECT doc_id AS id, doc_id % 3 AS tenant_id, CASE toxic WHEN 1 THEN 'deleted' ELSE 'active' END AS status, 'q' || quality AS label, doc_id * 7 % 101 AS created_at, quality FROM labels) "


@query(_NOTES + "SELECT id, label, status, created_at FROM notes WHERE status <> 'deleted' AND tenant_id = 1 AND quality = 1 ORDER BY created_at DESC, id DESC LIMIT 30")
def annotations_page(spark, d):
    current = md.latest(_annotations(spark, d))
    found = current.where(md.annotation_filter(tenant_id=1, attrs={"grade": '"1"'}))
    return page(found, md.newest(found), 0, 30).select("id", "label", "status", "created_at")


@query(_NOTES + "SELECT id, CASE WHEN label = 'q0' THEN 'resolved' ELSE status END AS status FROM notes WHERE tenant_id = 2")
def annotations_update(spark, d):
    current = md.latest(_annotations(spark, d))
    change = current.where("label = 'q0'").select("id", F.lit("resolved").alias("status"), F.lit(True).alias("set_status"))
    both = current.unionByName(md.update(current, change, ("status",), tenant_id=2))
    return md.latest(both).where("tenant_id = 2").select("id", "status")


@query("SELECT item_id AS id, item_id * 2 + 1 AS trace_id FROM benchmark WHERE item_id % 4 = 0 ORDER BY item_id % 10 DESC, item_id DESC LIMIT 50")
def associations_page(spark, d):
    a = _associations(spark, d).where(md.association_filter(dataset="golden", eval_run_id="run-1"))
    return page(a, md.newest(a)).select("id", "trace_id")


_CUTOFF = 9_300 * 86_400_000_000_000
_PLAN = SPANS_SQL + f""", found AS (SELECT trace_id, max(max_ts) AS last_ts FROM folded GROUP BY trace_id HAVING max(max_ts) <= {_CUTOFF}),
why AS (
  SELECT doc_id AS trace_id, 1 AS r, 'annotation' AS reason FROM labels WHERE toxic = 0
  UNION SELECT item_id * 2 + 1, 2, 'datasetAssociation' FROM benchmark
  UNION SELECT item_id * 2 + 1, 3, 'snapshot' FROM benchmark WHERE item_id % 3 = 0
  UNION SELECT item_id * 2 + 1, 4, 'evalLink' FROM benchmark WHERE item_id % 4 = 0
  UNION SELECT item_id * 2 + 1, 5, 'pathMemory' FROM benchmark WHERE item_id % 5 = 0
), plan AS (SELECT f.trace_id, last_ts, coalesce(string_agg(reason, ',' ORDER BY r), '') AS reasons, count(reason) = 0 AS deletable FROM found f LEFT JOIN why USING (trace_id) GROUP BY f.trace_id, last_ts)
"""


def _plan(spark, d):
    spans = folded(spark, d)
    notes = md.latest(_annotations(spark, d))
    return spans, rt.plan(rt.candidates(spans, None, _CUTOFF), rt.protections(notes, _associations(spark, d)))


@query(_PLAN + "SELECT * FROM plan")
def retention_plan(spark, d):
    return _plan(spark, d)[1]


@query(
    _PLAN
    + "SELECT part, count(DISTINCT trace_id) AS trace_count, count(*) AS span_count, CAST(sum(event_count) AS BIGINT) AS event_count FROM (SELECT f.*, unnest(['candidate', CASE WHEN deletable THEN 'deletable' ELSE 'protected' END]) AS part FROM folded f JOIN plan USING (trace_id)) GROUP BY part"
)
def retention_stats(spark, d):
    return _sizes(spark, d).drop("estimated_bytes")


_BYTES = (
    "96 + " + " + ".join(f"coalesce(strlen({c}), 0)" for c in ("external_trace_id", "agent_name", "tool_name", "model", "input_text", "output_text"))
    + " + coalesce(list_sum(list_transform(logs, lambda x: strlen(x))), 0)" + "".join(f" + coalesce(strlen({a}) + {len(a)}, 0)" for a in tables.ATTRS)
)


def _sizes(spark, d):
    notes = md.latest(_annotations(spark, d))
    found = rt.candidates(folded(spark, d), None, _CUTOFF, sizes=True)
    return rt.plan_stats(rt.plan(found, rt.protections(notes, _associations(spark, d))))


@query(
    _PLAN
    + f"SELECT part, count(DISTINCT trace_id) AS trace_count, count(*) AS span_count, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum({_BYTES}) AS BIGINT) AS estimated_bytes FROM (SELECT f.*, unnest(['candidate', CASE WHEN deletable THEN 'deletable' ELSE 'protected' END]) AS part FROM folded f JOIN plan USING (trace_id)) GROUP BY part"
)
def retention_sizes(spark, d):
    """The stored bytes as well, which ``retention_stats`` leaves out."""
    return _sizes(spark, d)


@query(_PLAN + "SELECT trace_id, span_id, seq FROM ev WHERE seq <= 2 AND trace_id IN (SELECT trace_id FROM plan WHERE deletable) AND trace_id NOT IN (SELECT trace_id FROM ev WHERE seq > 2)")
def retention_apply(spark, d):
    rows, _ = rt.apply(_plan(spark, d)[1], tables.trace_events(spark, d), live_after=2)
    return rows.select("trace_id", "span_id", "seq")


@query(_PLAN + "SELECT count(*) AS deleted_traces, coalesce(array_to_string(list_sort(list(trace_id))[1:100], ','), '') AS sample_ids, 'policy' AS source FROM plan WHERE deletable")
def retention_audit(spark, d):
    a = rt.audit(_plan(spark, d)[1].where("deletable"), "policy", 1)
    return a.select("deleted_traces", F.array_join(F.col("sample_ids").cast("array<string>"), ",").alias("sample_ids"), "source")


@query(SPANS_SQL + "SELECT trace_id, span_id, seq, event_type, status, external_trace_id, model, loop_id FROM ev")
def wire_round_trip(spark, d):
    """Events written in the wire format and parsed again."""
    e = tables.trace_events(spark, d)
    fields = ["trace_id", "span_id", "ts", "seq", "event_type", "ext_span_id", "parent_span_id", "session_id", "status", "model", "external_trace_id"]
    loop = F.struct(F.regexp_replace(F.col("attrs")["loop_id"], '"', "").alias("loop_id"))
    batch = e.select(F.to_json(F.array(F.struct(*fields, loop.alias("attrs")))).alias("value"))
    return wire.parse(batch).select("trace_id", "span_id", "seq", "event_type", "status", "external_trace_id", "model", F.col("attrs")["loop_id"].alias("loop_id"))


@query(
    "SELECT user_id AS trace_id, event_id AS span_id, CAST(s AS BIGINT) AS seq, CASE WHEN s = 2 THEN CASE event_type WHEN 'error' THEN 1 ELSE 0 END END AS status, CASE WHEN s = 2 THEN CAST(event_id % 1000 AS BIGINT) END AS duration_ns, "
    "CASE WHEN s = 1 THEN 'm-' || event_type END AS model, CASE WHEN s = 1 THEN event_id % 97 END AS input_tokens, CASE WHEN s = 1 THEN event_type || chr(10) || 'of ' || user_id END AS input_text, CASE WHEN s = 1 THEN 'done ' || event_id END AS output_text, CASE WHEN s = 1 THEN user_id END AS session_id "
    "FROM events, (SELECT unnest([1, 2]) AS s)"
)
def otlp_round_trip(spark, d):
    """Events written as OTLP spans and parsed again."""
    e = _table(spark, d, "events").select("event_id", "user_id", "event_type")
    text = lambda k, v: F.to_json(F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value")))
    number = lambda k, v: F.to_json(F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("intValue")).alias("value")))
    who = F.col("user_id").cast("string")
    prompt = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit("of "), who).alias("content"))))
    attrs = F.concat_ws(
        ",", text("gen_ai.request.model", F.concat(F.lit("m-"), "event_type")), number("gen_ai.usage.prompt_tokens", F.col("event_id") % 97), text("gen_ai.prompt", prompt), text("session.id", who)
    )
    said = F.concat(F.lit('{"name":"gen_ai.choice","attributes":['), text("content", F.concat(F.lit("done "), F.col("event_id").cast("string"))), F.lit("]}"))
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    span = F.concat(
        F.lit('{"traceId":"'), hexed(F.col("user_id"), 32), F.lit('","spanId":"'), hexed(F.col("event_id"), 16), F.lit('","name":"'), "event_type",
        F.lit('","startTimeUnixNano":"1000","endTimeUnixNano":"'), (F.col("event_id") % 1000 + 1000).cast("string"),
        F.lit('","status":{"code":'), F.when(F.col("event_type") == "error", "2").otherwise("1"), F.lit('},"attributes":['), attrs, F.lit('],"events":['), said, F.lit("]}"),
    )
    body = e.select(F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":['), span, F.lit("]}]}]}")).alias("value"))
    return otlp.parse(body).select("trace_id", "span_id", "seq", "status", "duration_ns", "model", "input_tokens", "input_text", "output_text", "session_id")


@query(
    "SELECT doc_id, kind, CAST(CASE kind WHEN 0 THEN doc_id WHEN 1 THEN 1234567890123456789 + doc_id WHEN 2 THEN -1 - doc_id ELSE -9223372036854775808 + doc_id END AS BIGINT) AS id FROM documents, (SELECT unnest([0, 1, 2, 3]) AS kind)"
)
def u64_ids(spark, d):
    """Ids as texts of up to twenty digits: the BIGINT has the bits of the unsigned number."""
    docs = _table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("kind"))
    big = lambda n, sign=1: (F.lit(str(n)).cast("decimal(20,0)") + sign * F.col("doc_id")).cast("decimal(20,0)").cast("string")
    text = F.when(F.col("kind") == 0, F.concat(F.lit("000"), F.col("doc_id").cast("string"))).when(F.col("kind") == 1, big(1234567890123456789))
    text = text.when(F.col("kind") == 2, big((1 << 64) - 1, -1)).otherwise(big(1 << 63))
    return docs.select("doc_id", "kind", numeric_id(text).alias("id"))


@query(SPANS_SQL + f"SELECT trace_id, count(*) AS started FROM ev WHERE event_type = {START} GROUP BY trace_id")
def started_spans(spark, d):
    e = tables.trace_events(spark, d).where(F.col("event_type") == START)
    return e.groupBy("trace_id").agg(F.count("*").alias("started"))
