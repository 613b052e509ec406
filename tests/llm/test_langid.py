import zlib

import numpy as np

from spanloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    true = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    right = [r for r in held if r.lang_pred == true[r.doc_id]]
    assert len(right) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.accepted for r in right) / len(right) > 0.9


def test_probabilities_sum_to_one(spark):
    text = "abab abba cab " * 20
    s = langid.symbols(text)
    g = np.lib.stride_tricks.sliding_window_view(s, langid.ORDER)
    u, n = np.unique(g[g[:, -1] != langid.EDGE], axis=0, return_counts=True)
    model = langid.smooth(["x"], [u], [n])
    # after a known context, all symbols that were ever seen and one that was not
    context = [ord(c) for c in "aba"]
    chars = [*sorted(set(u[:, -1].tolist())), 0x3A9]
    rows = np.array([[*context, c] for c in chars], np.uint32)
    total = sum(np.exp(model.log_probabilities(np.concatenate([[1, 1, 1], r]).astype(np.uint32))[-1, 0]) for r in rows)
    assert abs(total - 1) < 1e-5


def test_awkward(spark, awkward):
    model = langid.fit(awkward)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(awkward, model).collect()}
    assert {(3, "und"), (4, "und"), (8, "und")} <= got
    assert langid.identify(awkward.limit(0), model).count() == 0
    nothing = langid.fit(awkward.where("lang is null"))
    assert nothing is None and {r.lang_pred for r in langid.identify(awkward, None).collect()} == {"und"}


def test_only_text_decides(spark, small):
    model = langid.fit(small)
    from pyspark.sql import functions as F

    a = langid.identify(small, model)
    b = langid.identify(small.withColumns({"lang": F.lit("zz"), "source": F.lit("zz"), "doc_id": F.col("doc_id") + 1000}), model)
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in a.collect()) == sorted((r.doc_id - 1000, r.lang_pred, r.score) for r in b.collect())


def by_hand(samples, text):
    """Cross-entropy of a text under interpolated Kneser-Ney, written down with dictionaries."""
    import math
    from collections import Counter

    def letters_of(t):
        out = []
        for ch in t:
            c = ch.lower() if ch.isalpha() else " "
            if c != " " or (out and out[-1] != " "):
                out.append(c)
        return ["^"] * 3 + out

    tables = {n: Counter() for n in range(1, 5)}
    for t in samples:
        s = letters_of(t)
        for i in range(3, len(s)):
            tables[4][tuple(s[i - 3 : i + 1])] += 1
    for n in (3, 2, 1):
        for g in tables[n + 1]:
            tables[n][g[1:]] += 1
    known = {g[0] for g in tables[1]}

    def p(gram):
        n = len(gram)
        below = 1 / (len(known) + 1) if n == 1 else p(gram[1:])
        table = tables[n]
        ones, twos = (sum(c == k for c in table.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1) if ones + twos else 0.5))
        same = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        if not same:
            return below
        return max(table[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * below

    s = letters_of(text)
    return -sum(math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3)


def test_scores_against_dictionaries(spark):
    texts = {"aa": ["banana bandana", "an anaconda"], "bb": ["Ünder the über dune", "tundra under"]}
    grams, counts = [], []
    for name in sorted(texts):
        s = np.concatenate([langid.symbols(t) for t in texts[name]])
        g = np.lib.stride_tricks.sliding_window_view(s, langid.ORDER)
        u, n = np.unique(g[g[:, -1] != langid.EDGE], axis=0, return_counts=True)
        grams.append(u)
        counts.append(n)
    model = langid.smooth(sorted(texts), grams, counts)
    for one in sorted(texts):
        alone = langid.smooth([one], [grams[sorted(texts).index(one)]], [counts[sorted(texts).index(one)]])
        for probe in ("a banana under the dune", "anaconda", "x y z"):
            assert abs(alone.entropies([probe])[0, 0] - by_hand(texts[one], probe)) < 1e-4
    assert model.entropies(["banana"]).argmin() == 0 and model.entropies(["under the dune"]).argmin() == 1


def test_bounds_of_the_sample(spark):
    rows = [(i, f"the cat sat on the mat {i} times and " * 20, "en") for i in range(400)] + [(1000, "ein sehr langer satz " * 20_000, "de")]
    df = spark.createDataFrame([(k + 0, t, n) for k, t, n in rows], "doc_id long, text string, lang string")
    folds = (0, 1, 2, 3, 4)
    got = langid.sample(df, folds, "doc_id", "text", "lang", 20_000, longest=5_000).collect()
    n = {x: sum(len(r.text) for r in got if r.lang == x) for x in ("en", "de")}
    assert 0 < n["de"] <= 5_000 and 5_000 < n["en"] < 20_000
    assert {r.lang for r in langid.sample(df, folds, "doc_id", "text", "lang", 20_000, max_langs=1).collect()} == {"en"}
    small = langid.fit(df, max_chars=100_000, max_model_bytes=20_000)
    assert small is None or small.size() <= 20_000


def test_marks_are_no_letters_but_stay_in_words():
    assert langid.has_letter(langid.symbols("हिन्दी")) and not langid.has_letter(langid.symbols("\u093f\u0301 12"))
    assert langid.BLANK not in langid.symbols("हिन्दी")
