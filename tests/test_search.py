import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import Dictionary, dictionary_tokens, python_tokens, tokens
from spanloom.operators import evaluate as ev, search as se
from spanloom.plans import registry


def test_tokens(spark):
    df = spark.createDataFrame([("疑似盗刷GPT4,风",), ("Hello, World 42",), (None,), ("",)], "t string")
    got = [r.x for r in df.select(tokens(F.col("t")).alias("x")).collect()]
    assert got == [["疑似", "似盗", "盗刷", "gpt4", "风"], ["hello", "world", "42"], [], []]
    assert python_tokens("疑似盗刷GPT4,风") == got[0]


def test_dictionary(spark):
    d = Dictionary.from_lines(["盗刷 50 n", "疑似 20 v", "刷卡 5 n"], extra=["风控"])
    assert d.tokens("疑似盗刷 ABC风控") == ["疑似", "盗刷", "abc", "风控"]
    got = spark.createDataFrame([("疑似盗刷",)], "t string").select(dictionary_tokens(d)(F.col("t")).alias("x")).first().x
    assert got == ["疑似", "盗刷"]


def brute(docs, query, k):
    cut = [python_tokens(t) for t in docs]
    n, avg = len(cut), sum(map(len, cut)) / len(cut)
    out = []
    for i, t in enumerate(cut):
        s = 0.0
        for q in sorted(set(python_tokens(query))):
            df, tf = sum(q in c for c in cut), t.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            out.append((-s, i))
    return [i for _, i in sorted((round(s, 9), i) for s, i in out)[:k]]


def test_bm25_equals_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(10)]
    docs = [" ".join(rnd.choices(words, k=rnd.randint(3, 7))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    for q in ("w1 w2", "w3", "w0 w9 w4"):
        got = se.bm25(df, q, ["id"], None).select("id", F.round("score", 9).alias("s")).orderBy(F.col("s").desc(), "id").limit(10).collect()
        assert [r.id for r in got] == brute(docs, q, 10)


def test_two_concepts_win(spark):
    df = spark.createDataFrame([(1, "信用卡盗刷风控处置"), (2, "盗刷报告"), (3, "午餐菜单")], "id long, text string")
    got = [r.id for r in se.bm25(df, "盗刷风控", ["id"]).collect()]
    assert got[0] == 1 and 3 not in got


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (3, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    assert [r.id for r in se.fuse([a, b], ["id"]).collect()] == [3, 1, 2]


def test_filtered_knn_and_dimensions(spark):
    v = spark.createDataFrame([(10, [0.0, 0.0], "a"), (11, [0.0, 1.0], "b"), (20, [0.0, 2.0], "a"), (9, [1.0], "a")], "id int, embedding array<float>, who string")
    assert [r.id for r in se.knn(v, [0.0, 0.0], ["id"], matching=F.col("who") == "a").collect()] == [10, 20]
    assert se.knn(v, [0.0] * 3, ["id"]).count() == 0


def test_inverted_file_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = se.InvertedFile.fit(vectors)
    cells = index.index(vectors).cache()
    hit = total = 0
    for r in vectors.where("vec_id % 100 = 0").collect():
        want = {x.vec_id for x in se.knn(vectors, r.embedding, ["vec_id"], 10).collect()}
        got = {x.vec_id for x in index.search(cells, r.embedding, ["vec_id"], 10, probes=12).collect()}
        hit, total = hit + len(want & got), total + len(want)
    assert hit / total >= 0.9


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_registered_index_recall(spark, d):
    """The registered query's own parameters, over all vec_id % 100 = 0."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").cache()
    hit = total = 0
    for r in vectors.where("vec_id % 100 = 0").collect():
        want = {x.vec_id for x in se.knn(vectors, r.embedding, ["vec_id"], 10).collect()}
        got = {x.vec_id for x in registry.QUERIES["approximate_knn"](spark, d, probe=r.embedding).collect()}
        hit, total = hit + len(want & got), total + len(want)
    assert hit / total >= 0.9


def test_request_modes():
    embed = lambda t: [float(len(t))]
    assert se.request_mode({"text": "abc", "vector": [1.0]}, embed) == ("abc", [1.0])
    assert se.request_mode({"text": "abc", "mode": "semantic"}, embed) == (None, [3.0])
    assert se.request_mode({"text": "abc", "mode": "hybrid"}, embed) == ("abc", [3.0])
    assert se.request_mode({"text": "abc"}, None) == ("abc", None)
    assert se.search_mode("x", None) == "text" and se.search_mode(None, [1.0]) == "vector" and se.search_mode("x", [1.0]) == "hybrid"


def test_scoring_and_datasets(spark):
    rows = [(1, i, "a", t) for i, t in enumerate(["结论明确", "抱歉无法判断", "无法执行", None])]
    s = spark.createDataFrame(rows, "trace_id long, span_id long, agent_name string, output_text string")
    score = ev.keyword_score(["无法", "抱歉"])
    failed = F.col("output_text").contains("无法") | F.col("output_text").contains("抱歉")
    d = ev.collect_into_dataset(None, s, failed)
    assert d.count() == 2 and ev.collect_into_dataset(d, s, failed).count() == 0
    strict, lenient = ev.eval_summary(ev.evaluate(d, score)), ev.eval_summary(ev.evaluate(d, ev.keyword_score(["zzz"])))
    assert strict.where("agent_name is null").first().passed == 0 and lenient.where("agent_name is null").first().passed == 2
    assert ev.eval_summary(ev.evaluate(s.limit(0), score)).count() == 1
    custom = ev.custom_scorer(lambda r: (1500, "ok") if r["output_text"] else None, ["output_text"])
    got = s.select(custom.alias("x")).collect()
    assert [r.x and r.x.score for r in got] == [1000, 1000, 1000, None]


def test_session_classes(spark):
    rows = [(1, 1, "q", "fine", 0), (2, 1, "q", "无法", 0), (2, 2, "r", "fine", 0), (3, 1, "q", "无法", 0), (3, 2, "r", None, 0), (4, 1, "q", "a", 0), (4, 2, "q", "b", 0)]
    t = spark.createDataFrame(rows, "session_id long, turn long, input_text string, answer string, error_count int")
    got = {r.session_id: (r.failed_turns, r.resolved, r.looped, r.score) for r in ev.session_eval(t, ["无法"]).collect()}
    assert got == {1: (0, True, False, 1000), 2: (1, True, False, 1000), 3: (2, False, True, 0), 4: (0, True, True, 500)}


def test_index_of_awkward_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.5, 1.0])], "vec_id long, embedding array<float>")
    index = se.InvertedFile.fit(df)
    assert [r.vec_id for r in index.search(index.index(df), [0.0, 1.0], ["vec_id"], 10).collect()] == [1, 5]
    empty = se.InvertedFile.fit(df.limit(0))
    assert empty.search(empty.index(df.limit(0)), [0.0, 1.0], ["vec_id"], 10).count() == 0


def test_equal_documents_tie_in_postings(spark):
    """Parts of a score are added in one order, so copies tie exactly and the scores are those of the direct search."""
    docs = spark.createDataFrame([(i, "the apache license under the sun " + "word " * (i % 3)) for i in range(600)] + [(i, "apache sun") for i in range(600, 640)], "doc_id long, text string").repartition(7)
    lengths = docs.select("doc_id", F.size(tokens(F.col("text"))).alias("doc_len"))
    query = "under the apache license sun"
    got = se.bm25_from_postings(se.postings(docs, ["doc_id"]), lengths, query, ["doc_id"], 640).collect()
    assert got == se.bm25(docs, query, ["doc_id"], 640).collect()
    assert len({r.score for r in got}) == 4
