"""Sharding by weighted rendezvous hashing of stable record keys (DataFrame functions only).

Every record key scores each shard with ``-ln(u) / weight`` where ``u`` is a uniform
hash of (seed, shard, key); the lowest score wins.  A key's shard depends only on the
key, the seed and the shard weights, so one more shard takes records only into itself.

Slots number the records of a shard gaplessly from 0.  They come from a distributed
prefix sum: records fall into about sqrt(n) hash buckets per shard, bucket counts are
summed in order, and only the inside of a bucket is ordered by a window.  Equal records
are counted before the first shuffle and spread out again afterwards, so copies of one
record never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, table, unit_hash

#: Shards of the registered query, all of equal weight.
SHARDS = 8
SEED = "rendezvous"
TWO52 = float(1 << 52)


def choose_shard(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """The winning shard number (INT) of a key. A null key is a key of its own."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("shard weights must be positive")
    scores = [
        F.struct(
            (-F.log((unit_hash(f"{seed}:{n}", key) + F.lit(0.5)) / F.lit(TWO52)) / F.lit(float(w))).alias("score"),
            F.lit(n).alias("shard"),
        )
        for n, w in enumerate(weights)
    ]
    best = F.least(*scores) if len(scores) > 1 else scores[0]
    return best["shard"].cast("int")


def assign(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """Shard, slot and grown shard of every record.

    Returns (key, size, text_crc32, law, shard, slot, grown_shard), one row per input row.
    Null text counts as an empty one (size 1, checksum 0); a null key is hashed as a key;
    repeated rows get slots of their own; an empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(body).cast("long") + F.lit(1).cast("long")).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )
    distinct = rows.groupBy("k", "size", "crc").agg(F.count("*").alias("copies"))
    placed = distinct.withColumns(
        {
            "shard": choose_shard(F.col("k"), weights, seed),
            "grown": choose_shard(F.col("k"), [*weights, grown_weight], seed),
            "u": unit_hash(f"{seed}:slot", F.col("k"), F.col("crc"), F.col("size")),
        }
    )
    placed = checkpointed(placed)
    per_shard = placed.groupBy("shard").agg(F.ceil(F.sqrt(F.count("*"))).alias("buckets"))
    # at most as many rows as there are shards, a parameter
    placed = placed.join(F.broadcast(per_shard), "shard").withColumn(
        "bucket", F.floor(F.col("u") / F.lit(TWO52) * F.col("buckets")).cast("long")
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.sum("copies").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    )
    inside = (
        Window.partitionBy("shard", "bucket")
        .orderBy("u", "k", "size", "crc")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.withColumn("offset", F.coalesce(F.sum("copies").over(inside), F.lit(0).cast("long"))).join(
        starts, ["shard", "bucket"]
    )
    first = F.col("start") + F.col("offset")
    slots = F.sequence(first, first + F.col("copies") - F.lit(1).cast("long"))
    return numbered.select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.explode(slots).alias("slot"),
        F.col("grown").alias("grown_shard"),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def _winner(shards: int) -> str:
    hashed = f"CAST('0x' || substr(md5('{SEED}:' || n || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)"
    return f"list_sort(list_transform(range({shards}), lambda n: {{'score': -ln(({hashed} + 0.5) / {TWO52}), 'n': n}}))[1].n"


#: The same shards and slots in DuckDB; the checksum's table is made by its rule, a text's bytes are folded one by one.
OP9_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT))) AS t),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
  FROM documents
), sums AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS crc FROM d, crc
), placed AS (
  SELECT *, {_winner(SHARDS)} AS shard, {_winner(SHARDS + 1)} AS grown,
    CAST('0x' || substr(md5('{SEED}:slot:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || crc || ':' || size), 1, 13) AS BIGINT) AS u
  FROM sums
)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY u, doc_id NULLS FIRST, size, crc) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM placed
"""
