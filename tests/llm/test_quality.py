import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in often for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_counts(spark, labels, which, request):
    docs = request.getfixturevalue(which)
    got = quality.judge(docs, labels).collect()
    key = lambda r: (r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert sorted(map(key, got)) == sorted((r.doc_id or -1, *by_hand(r.text)) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in got)


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.1), (9, 1000, 0.0125), (200, 20_000, 0.0125), (5, 5, 0.2), (0, 1, 0.5)]
    for k, n, p in cases:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first().x
        assert got == pytest.approx(1.0 if k >= n * p else exact, rel=1e-6)


def _labelled(spark, n_good, n_bad):
    good = " ".join(f"plain{i}" for i in range(60))
    bad = " ".join(f"plain{i}###" for i in range(60))
    rows = [(i, good if i < n_good else bad, "en", 1 if i < n_good else 0) for i in range(n_good + n_bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    return df.select("doc_id", "text", "lang"), df.select("doc_id", "quality")


def test_enough_labels_certify_a_cutoff(spark):
    docs, marks = _labelled(spark, 900, 60)
    got = quality.judge(docs, marks).collect()
    assert all(r.kept == (r.doc_id < 900) for r in got)
    assert {r.failed_rules for r in got} == {"", "symbol_ratio"}


def test_few_labels_certify_none(spark):
    docs, marks = _labelled(spark, 100, 20)
    assert all(r.kept for r in quality.judge(docs, marks).collect())
    assert all(r.kept for r in quality.judge(docs, marks.limit(0)).collect())
    assert quality.judge(docs.limit(0), marks).count() == 0


def test_a_rule_that_hits_good_documents_is_not_certified(spark):
    docs, _ = _labelled(spark, 900, 60)
    marks = docs.select("doc_id", F.lit(1).alias("quality"))
    assert all(r.kept for r in quality.judge(docs, marks).collect())


def test_rows_ride_along(spark, awkward, labels):
    got = quality.judge(awkward, labels, with_row=True).where("not kept").select("row.*")
    assert got.columns == awkward.columns
