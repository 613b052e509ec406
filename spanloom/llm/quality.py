"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every rule rejects a document whose feature exceeds a cutoff.  Cutoffs come from the
labelled documents, per stratum (language): a cutoff is *certified* when the exact
binomial test refutes a false-rejection rate above the rule's share of the risk, that is
when P(Bin(n, risk) <= k) for the k good documents it rejects among n is at most the level
divided by the number of tests (Bonferroni over strata, rules and grid cutoffs), which is
the same as an exact upper confidence bound below the risk.  All certified cutoffs hold at
once, so the one that separates best may be picked among them; without a certified cutoff a
rule rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, checkpointed, table

SYMBOLS = r"[#*$%&|<>]"
#: Share of a stratum's good documents that all rules together may reject, and the level of that guarantee.
RISK = 0.05
LEVEL = 0.05
#: A cutoff is picked by bad documents rejected less this many times the good ones.
GOOD_COSTS = 20.0
#: Grid of cutoffs of each rule, loosest first.
GRID = {
    "symbol_ratio": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "dup_line_ratio": (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}
#: Strata up to this number are broadcast (a short row each), more are joined by a shuffle.
BROADCAST_STRATA = 10_000


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counted features of every whole text; null texts count as empty.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines (BIGINT).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    out = docs.withColumns(
        {
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
            "__words": words,
            "__lines": lines,
        }
    )
    gram = F.transform(
        F.when(F.size("__words") >= 3, F.sequence(F.lit(0), F.size("__words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.concat_ws(
                " ", F.get(F.col("__words"), i), F.get(F.col("__words"), i + 1), F.get(F.col("__words"), i + 2)
            ).alias("g"),
            i.alias("i"),
        ),
    )
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__grams": F.sort_array(gram),
        }
    )
    grams = F.col("__grams")
    starts = F.transform(
        F.filter(
            grams,
            lambda x, k: ((k > 0) & (F.get(grams, k - 1)["g"] == x["g"])) | F.coalesce(F.get(grams, k + 1)["g"] == x["g"], F.lit(False)),
        ),
        lambda x: x["i"],
    )
    out = out.withColumn("__starts", F.sort_array(starts))
    covered = F.aggregate(
        F.col("__starts"),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", covered).drop("__words", "__lines", "__grams", "__starts")
    # a filter on the counts must not be pushed below them, where it would take them again for each
    # mention; filters do not pass a generator
    return out.select(F.inline(F.array(F.struct(*out.columns))))


def ratios() -> dict[str, Column]:
    """The features that rules compare, each growing with badness."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, carried back by eight products."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi))
    inv = F.lit(1.0) / y
    series = series + inv / 12 - inv * inv * inv / 360 + inv * inv * inv * inv * inv / 1260
    for i in range(8):
        series = series - F.log(x + F.lit(float(i)))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n p, and 1 from there on.

    Terms are added downward from k; below the mean they shrink, at first slowly, so
    20 sqrt(n p) + 60 of them leave a remainder that the geometric bound covers: exact for
    small k, otherwise an upper bound equal to the tail within rounding.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_top = (
        log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    )
    odds = (1 - p) / p
    terms = F.least(kd, F.ceil(20 * F.sqrt(nd * p)) + 60).cast("int")
    acc = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct(
            (a["t"] * (kd - j) / (nd - kd + j + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s")
        ),
        # after the last term added, t is the next one; what follows shrinks at least as fast
        lambda a: a["s"] + a["t"] / (1 - F.least(F.lit(0.999999), kd / (nd - kd + 1) * odds)),
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * acc))


def certified_cutoffs(
    labelled: DataFrame, stratum: str, good: str, risk: float = RISK, level: float = LEVEL, grid: dict = GRID
) -> DataFrame:
    """The cutoff of each stratum and rule: (stratum, rule, cutoff).

    ``labelled`` has the ratios, the stratum and a BOOLEAN column ``good``.  Counts are
    histograms over the grid, so only (stratum, rule, bin) sums are ordered.
    """
    values = ratios()
    bins = []
    for name, cuts in grid.items():
        up = sorted(cuts)
        passed = sum((F.when(values[name] > F.lit(float(c)), 1).otherwise(0) for c in up), F.lit(0))
        bins.append(F.struct(F.lit(name).alias("rule"), passed.alias("bin")))
    hist = (
        labelled.select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), F.explode(F.array(*bins)).alias("x"))
        .groupBy("stratum", "x.rule", "x.bin")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    # every grid cutoff of a rule, also those whose bin is empty
    cuts = F.create_map(*[x for n, c in grid.items() for x in (F.lit(n), F.array(*[F.lit(float(v)) for v in sorted(c)]))])
    per_rule = hist.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"), F.collect_list(F.struct("bin", "good", "bad")).alias("bins")
    )

    def above(what: str) -> Column:
        return F.aggregate(
            F.filter("bins", lambda b: b["bin"] > F.col("g")), F.lit(0).cast("long"), lambda a, b: a + b[what]
        )

    tested = per_rule.select("*", F.posexplode(cuts[F.col("rule")]).alias("g", "cutoff"))
    tested = tested.withColumns({"k": above("good"), "gain": above("bad")})
    n_tests = F.lit(float(sum(len(c) for c in grid.values()))) * F.col("strata")
    strata = labelled.agg(F.count_distinct(F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("strata"))
    tested = tested.join(F.broadcast(strata))  # one row
    sure = binomial_tail(F.col("k"), F.col("n_good"), risk / len(grid)) <= level / n_tests
    worth = F.col("gain") - GOOD_COSTS * F.col("k")
    order = Window.partitionBy("stratum", "rule").orderBy(worth.desc(), F.col("cutoff").desc())
    return (
        tested.where(sure & (F.col("gain") > 0) & (worth > 0))
        .withColumn("r", F.row_number().over(order))
        .where("r = 1")
        .select("stratum", "rule", "cutoff")
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label_key: str = "doc_id",
    quality: str = "quality",
    with_row: bool = False,
    **risk,
) -> DataFrame:
    """Verdict on every document.

    Returns (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    failed_rules), and with ``with_row`` the whole input row as the struct ``row``.  ``kept`` is false where the base rules fail or a certified cutoff is
    exceeded.  Null and empty texts have no words and fail; null strata are a stratum of their
    own, as are empty ones; labels with a null key or quality are ignored, several labels of one key count as good
    only if all are; repeated rows are judged each; an empty table gives no rows, empty labels
    leave the base rules alone; other columns are ignored.
    """
    # a mark before every name, so that null is apart from an empty one
    named = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    own = {"__key": F.col(key), "__stratum": named, "__text": F.col(text)}
    if with_row:
        own["__row"] = F.struct(*[F.col(c) for c in docs.columns])
    slim = docs.select(*[c.alias(n) for n, c in own.items()])
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]
    marks = (
        labels.where(F.col(label_key).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(label_key).alias("__label"))
        .agg((F.min(quality) > 0).alias("__good"))
    )
    # only labelled documents go into the cutoffs
    joined = lambda rows: rows.join(marks, F.col("__key") == F.col("__label"))
    if with_row:
        # with whole rows to carry, the counts are taken again for the labelled ones rather than written out
        narrow = features(slim, "__text").drop("__text")
        labelled = features(joined(slim.drop("__row")), "__text")
    else:
        narrow = checkpointed(features(slim, "__text").drop("__text"))
        labelled = joined(narrow)
    # the documents of a key that repeats count once: a label is one observation
    seen = labelled.groupBy("__key", "__good").agg(F.min(F.struct("__stratum", *numbers)).alias("x"))
    labelled = seen.select("__key", "__good", "x.*")
    cutoffs = certified_cutoffs(labelled, "__stratum", "__good", **risk)
    limits = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    limits = checkpointed(limits)
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    judged = narrow.join(limits, F.col("__stratum") == F.col("stratum"), "left")
    failed = F.array_compact(
        F.array(*[F.when(r > F.col("limits")[n], F.lit(n)) for n, r in ratios().items()])
    )
    return judged.withColumn("failed", failed).select(
        F.col("__key").alias(key),
        *numbers[:5],
        base_failed().alias("base_failed"),
        (~base_failed() & (F.size("failed") == 0)).alias("kept"),
        F.array_join("failed", ",").alias("failed_rules"),
        *([F.col("__row").alias("row")] if with_row else []),
    )


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_RULES_SQL = {
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
}
_TESTS = sum(len(c) for c in GRID.values())


def quality_sql(risk: float, level: float) -> str:
    """The same verdicts in DuckDB; the binomial tail is summed up term by term."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
grams AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(o) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY r
), f AS (
  SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
), observed AS (
  SELECT f.*, good FROM f JOIN (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines) = 1
), tested AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND v > cutoff) AS k, count(*) FILTER (NOT good AND v > cutoff) AS gain
  FROM ({" UNION ALL ".join(f"SELECT stratum, good, '{n}' AS rule, {v} AS v FROM observed" for n, v in _RULES_SQL.items())})
  JOIN (VALUES {", ".join(f"('{n}', CAST({c} AS DOUBLE))" for n, cs in GRID.items() for c in cs)}) AS g(rule, cutoff) USING (rule) GROUP BY ALL
), sure AS (
  SELECT *, gain - {GOOD_COSTS} * k AS worth FROM (SELECT *, {risk / len(GRID)} AS p FROM tested)
  WHERE gain > 0 AND k < n * p AND {level} / ({_TESTS} * (SELECT count(DISTINCT stratum) FROM observed))
    >= list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))))
), best AS (
  SELECT * FROM sure WHERE worth > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY worth DESC, cutoff DESC) = 1
), judged AS (
  SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    concat_ws(',', {", ".join(f"CASE WHEN {v} > (SELECT max(cutoff) FROM best b WHERE b.stratum = f.stratum AND rule = '{n}') THEN '{n}' END" for n, v in _RULES_SQL.items())}) AS failed_rules
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM judged
"""


OP4_SQL = quality_sql(RISK, LEVEL)
#: A risk at which the labels of small tables certify cutoffs too.
LENIENT = 0.4


def quality_rules_lenient(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), risk=LENIENT)


LENIENT_SQL = quality_sql(LENIENT, LEVEL)
