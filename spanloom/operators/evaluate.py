"""Scoring spans and sessions, datasets of frozen examples, retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ("trace_id", "span_id")
PASSED, FAILED = "通过", "未通过"


def keyword_score(bad_words: Sequence[str], text: str = "output_text") -> Column:
    """0 if the text has a bad word, else 1000; a null text is not scored."""
    bad = F.lit(False)
    for w in bad_words:
        bad = bad | F.col(text).contains(w)
    return F.when(F.col(text).isNotNull(), F.when(bad, 0).otherwise(1000))


def score_label(score: Column) -> Column:
    return F.when(score == 0, FAILED).when(score.isNotNull(), PASSED)


def custom_scorer(score: Callable[[dict], tuple[int, str] | None], columns: Sequence[str]) -> Column:
    """A user's scorer over span fields as an Arrow UDF: struct(score, label), null where it declines; scores stop at 1000."""

    @F.arrow_udf("struct<score: int, label: string>")
    def run(*fields: pa.Array) -> pa.Array:
        rows = zip(*(f.to_pylist() for f in fields), strict=True)
        found = [score(dict(zip(columns, r, strict=True))) for r in rows]
        kind = pa.struct([("score", pa.int32()), ("label", pa.string())])
        return pa.array([None if f is None else {"score": max(0, min(1000, f[0])), "label": f[1]} for f in found], kind)

    return run(*[F.col(c) for c in columns])


def evaluate(spans: DataFrame, score: Column, label: Column | None = None) -> DataFrame:
    """Scored spans as patches to write back: (trace_id, span_id, agent_name, eval_score, eval_label)."""
    scored = spans.select(*KEYS, "agent_name", F.when(score.isNotNull(), F.least(score, F.lit(1000))).cast("int").alias("eval_score"), *([] if label is None else [label.alias("eval_label")]))
    if label is None:
        scored = scored.withColumn("eval_label", score_label(F.col("eval_score")))
    return scored.where("eval_score is not null")


def eval_summary(scored: DataFrame, threshold: int = 600) -> DataFrame:
    """Scored, passed and mean score (whole numbers): all together (agent null), then each agent; the first row is there even without data."""
    aggs = [
        F.count("eval_score").alias("scored"),
        F.count_if(F.col("eval_score") >= threshold).alias("passed"),
        F.coalesce(F.expr("sum(eval_score) div count(eval_score)"), F.lit(0)).alias("avg_score"),
    ]
    own = scored.where("eval_score is not null")
    overall = own.agg(*aggs).select(F.lit(None).cast("string").alias("agent_name"), "scored", "passed", "avg_score")
    return overall.unionByName(own.where("agent_name is not null").groupBy("agent_name").agg(*aggs))


def collect_into_dataset(dataset: DataFrame | None, spans: DataFrame, matching: Column, expected: Column | None = None) -> DataFrame:
    """New examples for a dataset: matching spans that it does not have yet, frozen as they are."""
    new = spans.where(matching).withColumn("expected", F.lit(None).cast("string") if expected is None else expected)
    return new if dataset is None else new.join(dataset.select(*KEYS), list(KEYS), "left_anti")


def list_datasets(examples: DataFrame) -> DataFrame:
    return examples.groupBy("name").agg(F.count("*").alias("examples"))


def retrieval_metrics(ranking: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """Recall, MRR and NDCG at k of each query.

    ``ranking`` has (query, item, rank); repeats of an item count once, at its best rank.
    ``grades`` has (query, item, grade); items of grade 0 are not relevant.
    """
    first = ranking.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    place = Window.partitionBy("query").orderBy("rank", "item")
    top = first.withColumn("pos", F.row_number().over(place)).where(F.col("pos") <= k)
    good = grades.where("grade > 0")
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    hit = top.join(good, ["query", "item"]).groupBy("query").agg(
        F.count("*").alias("hits"), F.min("pos").alias("first"), F.sum(gain(F.col("grade"), F.col("pos"))).alias("dcg")
    )
    best = Window.partitionBy("query").orderBy(F.col("grade").desc(), "item")
    ideal = good.withColumn("i", F.row_number().over(best)).groupBy("query").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias("idcg")
    )
    return ideal.join(hit, "query", "left").select(
        "query",
        (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
    )


def macro_average(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")])


def session_eval(turns: DataFrame, bad_words: Sequence[str]) -> DataFrame:
    """Sessions from their turns (session_id, turn, input_text, answer, error_count).

    A turn fails with an error, without an answer or with a bad word in it.  A session is resolved
    if its last turn is fine, looped after two failures in a row or a repeated question; its
    score is 0 unresolved, 500 resolved after loops, 1000 otherwise.
    """
    bad = F.col("answer").isNull()
    for w in bad_words:
        bad = bad | F.col("answer").contains(w)
    t = turns.withColumn("failed", (F.col("error_count") > 0) | bad)
    order = Window.partitionBy("session_id").orderBy("turn")
    asked = Window.partitionBy("session_id", "input_text")
    t = t.withColumns(
        {
            "again": F.col("failed") & F.coalesce(F.lag("failed").over(order), F.lit(False)),
            "repeated": F.col("input_text").isNotNull() & (F.count("*").over(asked) > 1),
        }
    )
    out = t.groupBy("session_id").agg(
        F.count("*").alias("turns"),
        F.count_if("failed").alias("failed_turns"),
        (~F.max_by("failed", "turn")).alias("resolved"),
        F.bool_or(F.col("again") | F.col("repeated")).alias("looped"),
    )
    score = F.when(~F.col("resolved"), 0).when(F.col("looped"), 500).otherwise(1000)
    label = F.when(~F.col("resolved"), "未解决").when(F.col("looped"), "绕圈后解决").otherwise("一次到位")
    return out.withColumns({"score": score, "label": label})


def session_report(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("label").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"))
