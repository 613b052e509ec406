import random
import re
from collections import Counter

import corpus_pipeline
from spanloom.llm import bpe, neardup, pii, quality

from .test_mixing import targets
from .test_neardup import by_hand as links_by_hand
from .test_quality import by_hand as counts_by_hand

D = "/root/testdata/sf0.001"


def test_stages_by_hand(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs.collect()
    # few labels: only the base rules decide
    kept = {k: t for k, t in texts.items() if not counts_by_hand(t)[-1]}
    assert {r.doc_id for r in after["quality"]} == set(kept)
    rows = sorted(kept.items())
    stays = {k for k, _, c in links_by_hand(rows) if k == c}
    assert {r.doc_id: r.text for r in after["near_duplicates"]} == {k: kept[k] for k in stays}
    hidden = {k: pii.pseudonymize_text(kept[k])[0] for k in stays}
    assert {r.doc_id: (r.text, r.n_chars) for r in after["personal_data"]} == {k: (t, len(t)) for k, t in hidden.items()}
    assert {r.doc_id for r in after["mixing"]} <= stays and all(hidden[r.doc_id] == r.text for r in after["mixing"])
    tok = bpe.tokenizer(bpe.vocabulary_path())
    assert sorted((r.doc_id, r.ids) for r in after["bpe"]) == sorted((r.doc_id, tok.encode(r.text, add_special_tokens=False).ids) for r in after["mixing"])


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert quality.RISK > 0 and neardup.THRESHOLD == 0.8


def test_awkward(spark, awkward):
    """The base rules reject each of these rows, so every later stage gets them all, and then none."""
    quality_stage, *later = [stage for _, stage in corpus_pipeline.STAGES]
    assert all(counts_by_hand(r.text)[-1] for r in awkward.collect())
    none = quality_stage(spark, awkward, D)
    assert none.columns == awkward.columns and none.count() == 0
    for stage in later:
        out = stage(spark, awkward, D)
        assert stage is later[-1] or out.columns == awkward.columns
        assert len(out.collect()) > 0
        assert stage(spark, awkward.limit(0), D).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_id_of_many_texts(spark):
    """One row a class, whatever the ids of its rows."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, a + " end"), (1, "start " + a), (2, a), (1, b), (3, c), (1, c + " end"), (None, d), (None, d + " end"), (5, b + " end"), (1, b), (6, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, D).collect()
    assert sorted((str(r.doc_id), next((x for x in "abcd" if f"{x}0" in r.text), "")) for r in got) == [("1", "a"), ("1", "b"), ("1", "c"), ("6", ""), ("None", "d")]


def test_mix_of_one_id(spark):
    """A source under one id meets its target, and equal rows are taken together."""
    rnd = random.Random(5)
    rows = [(1, " ".join(f"w{rnd.randrange(999)}" for _ in range(rnd.randint(5, 40))), "en", "a", 1) for _ in range(900)]
    rows += [(None if i % 2 else 2, f"x{i} y z", None, "a", None) for i in range(40)] + [(3, "same text here", "en", "b", 1)] * 200
    rows += [(i, f"t{i} " * 20, "en", "bc"[i % 2], 1) for i in range(10, 1000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes, got = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    out = corpus_pipeline.mix_sources(spark, docs, D).collect()
    for r in out:
        got[r.source] += len(r.text.split())
    assert out and {tuple(r) for r in out} <= set(rows)
    for s, t in targets(sizes).items():
        assert abs(got[s] - t) <= 0.1 * t, (s, got[s], t)


def test_awkward_rows_that_stay(spark, tmp_path):
    """Nulls, repeats, long texts and clashing extra columns that the first stage keeps go through all stages."""
    text = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    schema = SCHEMA + ", n_words string, bucket string, s binary, label int, k int"
    rows = [(None, text("a", 80), None, None, None), (1, text("a", 81), "en", "s", 1), (2, text("b", 70), None, "", 2), (2, text("b", 70), None, "", 2), (2, text("c", 60_000), "de", None, None),
            (3, None, None, None, None), (4, "", "en", "s", 0), (None, "x@y.org 4111111111111111 " + text("d", 90), "", "t", 9)]
    docs = spark.createDataFrame([(*r, "x", None, b"y", 1, None) for r in rows], schema)
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = Counter((r.doc_id, (r.text or "")[:2]) for r in docs.collect()) if name != "bpe" else docs.count()
        if name == "quality":
            assert got == Counter([(None, "a0"), (1, "a0"), (2, "b0"), (2, "b0"), (2, "c0"), (None, "x@")])
        if name == "near_duplicates":
            assert got == Counter([(1, "a0"), (2, "b0"), (2, "c0"), (None, "x@")])
        if name == "personal_data":
            assert sum(got.values()) == 4 and (None, "x@") not in got
        if name == "mixing":
            kept = sum(got.values())
            assert kept > 0
    assert got == kept
