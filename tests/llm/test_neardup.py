import random
import re
from collections import Counter, defaultdict

import pytest

from spanloom.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, threshold=0.8):
    """(links, class) of each row number by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    where = defaultdict(list)
    links, up = Counter(), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g])
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
        for g in s:
            where[g].append(i)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    return [(k if k is not None else -1, links[i], min(least[root(i)], default=-1)) for i, (k, _) in enumerate(rows)]


def check(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, s string, label int")
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_links, -1 if r.class_id is None else r.class_id) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got) == sorted(by_hand(rows))


def varied(rnd, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 8])
def test_planted_copies(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(7)
    rows, n = [], 0
    for size in (1, 1, 2, 3, 8, 60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 200))]
        for _ in range(size):
            rows.append((n, varied(rnd, base, rnd.choice([0, 0, 1, 2, 3, 5]))))
            n += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(80):  # a passage in common is no link
        rows.append((n, passage + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(150))))
        n += 1
    check(spark, rows)


def test_blocks_of_an_area(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    check(spark, [(i, varied(rnd, base, rnd.choice([0, 1, 2, 3]))) for i in range(90)])


def test_size_classes_of_an_area(spark, monkeypatch):
    """Prefixes of one text: links reach across size classes, and chains of them make one class."""
    monkeypatch.setattr(neardup, "BLOCK", 6)
    monkeypatch.setattr(neardup, "REACH", 2)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    check(spark, [(i, varied(rnd, base[: rnd.randrange(60, 400)], rnd.choice([0, 0, 1]))) for i in range(120)])


def test_components_get_few_edges(spark, monkeypatch):
    """A group of k near copies: neither call of ``components`` is given more edges than sets."""
    fed = []
    plain = neardup.components

    def counted(edges):
        fed.append(edges.where("a <> b").count())
        return plain(edges)

    monkeypatch.setattr(neardup, "components", counted)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in (200, 400):
        rows.append([(i, varied(rnd, base, 2)) for i in range(k)])
        got = neardup.near_duplicates(spark.createDataFrame(rows[-1], "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_links, r.class_id) for r in got) == sorted(by_hand(rows[-1]))
    assert fed[0] <= 200 and fed[2] <= 400 and fed[1] <= 200 and fed[3] <= 400


def test_one_key_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    rnd = random.Random(11)
    bases = [[f"w{b}x{i}" for i in range(100)] for b in range(4)]
    rows = [(1, varied(rnd, rnd.choice(bases), rnd.choice([0, 1, 2]))) for _ in range(40)]
    rows += [(1, " ".join(bases[0]))] * 25 + [(n, varied(rnd, bases[1], 1)) for n in range(2, 10)]
    check(spark, rows)


def test_awkward(spark, awkward, small):
    check(spark, [(r.doc_id, r.text) for r in awkward.collect()])
    check(spark, [(r.doc_id, r.text) for r in small.collect()])
    assert neardup.near_duplicates(small.limit(0)).count() == 0


def test_posterior_bound():
    least = neardup.fewest_matches(0.8, 1e-9, 192, 24)
    assert len(least) == 8 and list(least) == sorted(least) and least[-1] < 0.8 * 192


def test_thresholds_that_the_bands_do_not_serve_are_refused(small):
    for threshold in (0.5, 0.79, 1.01):
        with pytest.raises(ValueError):
            neardup.near_duplicates(small, threshold=threshold)
