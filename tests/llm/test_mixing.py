import re
from collections import defaultdict

import pytest

from spanloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > limit * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_sainte_lague_by_hand(spark):
    sizes = {f"s{i}": n for i, n in enumerate((9000, 400, 70, 5200, 33, 1200, 800))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    plan = {r.source: r for r in mixing.source_plan(df, blocks=500).collect()}
    v = {s: r.target for s, r in plan.items()}
    seats = dict.fromkeys(v, 0)
    n = int(sum(sizes.values()) // plan["s0"].block)
    for _ in range(n):
        best = max(v, key=lambda s: (v[s] / (2 * seats[s] + 1), -plan[s].pos))
        seats[best] += 1
    assert {s: min(x, 3 * plan[s].n_blocks) for s, x in seats.items()} == {s: r.quota for s, r in plan.items()}
    dealt = mixing.shard_quotas(mixing.source_plan(df, blocks=500)).collect()
    per_source, per_shard = defaultdict(int), defaultdict(int)
    for r in dealt:
        per_source[r.source] += r.blocks
        per_shard[r.shard] += r.blocks
    assert per_source == {s: r.quota for s, r in plan.items()} and max(per_shard.values()) - min(per_shard.values()) <= 1


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_targets_and_takes(spark, which, request):
    docs = request.getfixturevalue(which)
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = targets(sizes)
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.05 * t, 3), (s, taken[s], t)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark, small):
    assert mixing.mix(small.limit(0)).count() == 0
    none = small.selectExpr("doc_id", "cast(null as string) as text", "source")
    assert {r.taken for r in mixing.mix(none).collect()} == {0}


def test_shards_get_their_quotas(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = docs.groupBy("source").agg({"text": "count"}).collect()
    rows = mixing.mix(docs, blocks=2000).collect()
    own = {r.source: r.source_size for r in rows}
    plan = mixing.source_plan(spark.createDataFrame(list(own.items()), "source string, source_size long"), blocks=2000)
    block = {r.source: r.block for r in plan.collect()}
    quota = {(r.source, r.shard): r.blocks for r in mixing.shard_quotas(plan).collect()}
    words, total = defaultdict(int), defaultdict(int)
    for r in rows:
        assert sum(p.words for p in r.pieces) == r.taken
        for p in r.pieces:
            words[r.source, p.shard] += p.words
            total[p.shard] += p.words
    assert len(sizes) > 1 and set(words) <= set(quota) and set(total) == set(range(8))
    for k, n in quota.items():  # a source's last block may be short, in each of three passes
        assert n * block[k[0]] - 3 * block[k[0]] <= words[k] <= n * block[k[0]]
    assert max(total.values()) - min(total.values()) <= 4 * len(own) * max(block.values())


def test_a_few_words_beside_very_many(spark):
    """2e13 words beside 30: no overflow, the right words, and every block has one place."""
    sizes = spark.createDataFrame([("a", 20_000_000_000_000), ("b", 30)], "source string, source_size long")
    plan = mixing.source_plan(sizes)
    got = {r.source: r for r in plan.collect()}
    assert got["b"].target == 90 and got["b"].quota == 90 and abs(got["a"].quota - got["a"].target) <= 2
    n, step = got["a"].n_blocks, mixing.STEPS[0]
    for b in (0, 1, 65_535, 65_536, n - 1, 123_456_789_012):
        from pyspark.sql import functions as F

        found = spark.range(1).select(mixing.times_modulo(F.lit(step).cast("long"), F.lit(b).cast("long"), F.lit(n).cast("long")).alias("x")).first().x
        assert found == step * b % n
    per = {r.shard: r.blocks for r in mixing.shard_quotas(plan.where("source = 'a'")).collect()}
    assert sum(per.values()) == got["a"].quota and max(per.values()) - min(per.values()) <= 1
