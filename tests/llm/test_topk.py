import math
import random

from spanloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, qb int"


def by_hand(rows, k=10):
    ok = {}
    for r in rows:
        v = r[1]
        if r[0] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(r[0], []).append([math.floor(1024 * x) for x in v])
    out = []
    for q in sorted(i for i in ok if i % 100 == 0):
        (mine,) = {tuple(v) for v in ok[q]}
        found = sorted(
            (-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, vs in ok.items() if i != q for v in vs if len(v) == len(mine)
        )
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, **how).collect())


def test_random_and_tied_vectors(spark):
    rnd = random.Random(2)
    f = lambda x: float(int(x * 4096)) / 4096  # noqa: E731  exact in 32 bits
    rows = [(i, [f(rnd.gauss(0, 0.3)) for _ in range(16)], 1, "x", 1) for i in range(600)]
    rows += [(1000 + i, rows[5][1], 1, "x", 1) for i in range(40)]  # copies, and ties
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, rows, query_bytes=2 * 128, row_bytes=64 * 128, seeds=20) == by_hand(rows)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0], 1, "x", 1), (100, [1.0, float("nan")], 1, None, 1), (200, None, None, None, None), (300, [0.5, None], 1, "x", 1), (None, [9.0, 9.0], 1, "x", 1),
            (1, [float("inf"), 1.0], 1, "x", 1), (2, [1.0], 1, "x", 1), (3, [-1.0, 0.25], 1, "x", 1), (3, [-1.0, 0.25], 1, "x", 1), (400, [], 1, "x", 1), (500, [2.0, 1.0], 1, "x", 1), (0, [1.0, 2.0], 1, "x", 1)]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, []) == []


def test_large_components(spark):
    rows = [(0, [3.0e9, 1.0], 1, "x", 1), (1, [2.0e9, 5.0], 1, "x", 1), (2, [-1.0, 7.0], 1, "x", 1)]
    got = run(spark, rows)
    assert [g[2] for g in got] == [1, 2] and got[1][3] == math.floor(1024 * 3.0e9) * -1024 + 1024 * 7 * 1024


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(50, 37))
    exact = q @ x.T
    previous = None
    for seg in topk.levels(37):
        bound = topk.statistics(q, seg) @ topk.statistics(x, seg).T
        assert (bound >= exact - 1e-9).all()
        if previous is not None:
            assert bound.mean() <= previous.mean() + 1e-9
        previous = bound


def test_bounds_discard_most_pairs_of_clustered_vectors():
    import numpy as np

    rng = np.random.default_rng(4)
    centers = rng.normal(size=(50, 64))
    x = np.floor(1024 * (centers[rng.integers(0, 50, 6000)] + 0.1 * rng.normal(size=(6000, 64))))
    ids = np.arange(len(x))
    q, qid = x[ids % 100 == 0], ids[ids % 100 == 0]
    best = topk.search_block(qid, q, ids, x, 10)
    for i, (s, found) in zip(qid, best.rows, strict=True):
        score = (x @ x[i]).astype(np.int64)
        want = np.lexsort((ids, -score))
        want = want[want != i][:10]
        assert found.tolist() == want.tolist() and s.tolist() == score[want].tolist()
    assert best.exact < 0.1 * len(q) * len(x)
    # vectors without any structure: no bound can tell, all are still right
    y = np.floor(1024 * rng.normal(size=(3000, 64)))
    flat = topk.search_block(ids[:30], y[:30], ids[:3000], y, 10)
    for i in range(30):
        score = (y @ y[i]).astype(np.int64)
        want = np.lexsort((ids[:3000], -score))
        assert flat.rows[i][1].tolist() == want[want != i][:10].tolist()


def test_first_round_and_norms_leave_little():
    """A few long vectors are everybody's best: blocks without them are left at their first rows."""
    import numpy as np

    rng = np.random.default_rng(8)
    x = np.floor(100 * np.abs(rng.normal(size=(4000, 16))))
    x[:40] *= 100
    ids = np.arange(len(x))
    q = x[100:130]
    floor = np.sort(q @ x[:40].T, axis=1)[:, -10]
    best = topk.search_block(ids[100:130], q, ids[2000:], x[2000:], 10, floor)
    assert best.exact == 0 and all(len(r[0]) == 0 for r in best.rows)
