import hashlib
import math
import zlib
from collections import defaultdict

import pytest

from spanloom.llm import sharding


def shard_of(key, weights, seed=sharding.SEED):
    scores = []
    for n, w in enumerate(weights):
        h = int(hashlib.md5(f"{seed}:{n}:{'null' if key is None else key}".encode()).hexdigest()[:13], 16)
        scores.append((-math.log((h + 0.5) / 2**52) / w, n))
    return min(scores)[1]


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_against_python(spark, which, request):
    docs = request.getfixturevalue(which)
    got = sharding.assign(docs).collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        want.append((r.doc_id or -1, len(raw) + 1, zlib.crc32(raw), shard_of(r.doc_id, [1.0] * 8), shard_of(r.doc_id, [1.0] * 9)))
    assert sorted((r.doc_id or -1, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == sorted(want)
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, got)) == sorted(map(str, sharding.assign(docs.repartition(3)).collect()))


def test_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    n = {r.shard: r["count"] for r in sharding.assign(df, weights=(3.0, 1.0)).groupBy("shard").count().collect()}
    assert abs(n[0] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(df, weights=(1.0, 0.0))
    assert sharding.assign(df.limit(0)).count() == 0
