"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

1. Targets: sources share all tokens by weight; a target stops at ``repeat_limit`` times
   its source's size and the excess is shared again, which is one water level over the
   sources sorted by (limit / weight).
2. Quotas: the mix is cut into equal-token blocks; Sainte-Lague gives each source its
   number of blocks.  A divisor that hands out at most N and more than N - S blocks is
   applied at once, and the last ones (fewer than the S sources) go to the highest
   quotients, so no list of all quotients is made.
3. Seats are dealt to output shards in turn, which gives whole-number quotas per shard.
4. Selection: a source's own tokens, in the order of a seeded hash, form its blocks; a
   seeded affine permutation puts the block numbers in the order in which they take the
   source's seats, pass after pass.  A seat belongs to a shard, and it is taken as long as
   the shard's quota of the source lasts.  No block list is built: each record adds up the
   blocks that its token interval meets.

A record's interval comes from a distributed prefix sum over about sqrt(n) hash buckets
per source, so that a source with a third of all rows is not ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, checkpointed, table, unit_hash

WEIGHTS = (5, 2, 1)
SEED = "mix"
#: Blocks of the whole mix at least; small sources get finer blocks.
BLOCKS = 20_000
SHARDS = 8
REPEAT_LIMIT = 3
TWO52 = float(1 << 52)
#: Primes, one of which steps through a source's blocks.  Of numbers below 2**46, each has
#: at most one of them as a factor.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    blocks: int = BLOCKS,
    repeat_limit: int = REPEAT_LIMIT,
    source: str = "source",
    size: str = "source_size",
) -> DataFrame:
    """Target and Sainte-Lague quota of each source.

    ``sizes`` has one row per source.  Returns (source, source_size, pos, target, block,
    n_blocks, quota, first_seat).  The windows run over sources, not over records.
    """
    src = sizes.select(F.col(source).alias("source"), F.col(size).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("pos"), F.lit(len(weights))) + 1)
    src = src.withColumn("pos", (F.row_number().over(by_name) - 1).cast("int")).withColumn("w", w)
    src = src.withColumn("cap", (F.col("source_size") * repeat_limit).cast("double"))
    src = src.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "pos")
    src = src.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    )
    # the first source in this order that the level leaves below its limit sets the level for all later ones
    src = src.withColumn(
        "water",
        F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "pos", "level")))
        .over(everything)["level"],
    )
    src = src.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("w")))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    src = src.withColumn(
        "block",
        F.greatest(F.lit(1).cast("long"), F.floor(F.least(F.col("total") / blocks, F.coalesce(smallest, F.lit(1.0)) / 100)).cast("long")),
    )
    src = src.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    # Sainte-Lague: at most N seats by one divisor, the rest by highest quotient
    seats = F.floor(F.col("total") / F.col("block"))
    v, n, s = F.col("target"), F.col("seats").cast("double"), F.col("n_sources").cast("double")
    src = src.withColumn("seats", seats).withColumn("n_sources", F.count("*").over(everything))
    share = F.when(F.col("total") > 0, v / F.col("total")).otherwise(F.lit(0.0))
    src = src.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(share * (n - s / 2) + 0.5).cast("long")))
    src = src.withColumn("most", F.greatest(F.col("sure"), F.floor(share * (n + s / 2) + 0.5).cast("long")))
    open_seats = F.col("seats") - F.sum("sure").over(everything)
    src = src.withColumn("open", open_seats)
    rest = src.where("most > sure").select(
        "pos", "target", "open", F.explode(F.sequence(F.col("sure"), F.col("most") - F.lit(1).cast("long"))).alias("j")
    )
    rank = F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("j") + 1)).desc(), "pos", "j"))
    won = rest.withColumn("r", rank).where("r <= open").groupBy("pos").agg(F.count("*").alias("won"))
    src = src.join(won, "pos", "left").withColumn(
        "quota",
        F.least(F.col("sure") + F.coalesce(F.col("won"), F.lit(0).cast("long")), F.col("n_blocks") * repeat_limit),
    )
    seat = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return src.select(
        "source", "source_size", "pos", "target", "block", "n_blocks", "quota",
        F.coalesce(F.sum("quota").over(seat), F.lit(0).cast("long")).alias("first_seat"),
    )


def shard_quota(shards: int) -> Column:
    """Blocks of a source in each shard: seats are dealt in turn, so shard totals differ by one at most."""
    last = F.col("first_seat") + F.col("quota") - F.lit(1).cast("long")

    def dealt(upto: Column, shard: Column) -> Column:
        # whole numbers all the way; upto may be -1
        return (upto - shard - F.pmod(upto - shard, F.lit(shards).cast("long"))) / shards

    h = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    return F.transform(h, lambda x: (dealt(last, x) - dealt(F.col("first_seat") - F.lit(1).cast("long"), x)).cast("long"))


def shard_quotas(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The quotas as rows (source, shard, blocks)."""
    return plan.select("source", F.posexplode(shard_quota(shards)).alias("shard", "blocks")).withColumn("shard", F.col("shard").cast("long"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    blocks: int = BLOCKS,
    repeat_limit: int = REPEAT_LIMIT,
    seed: str = SEED,
    shards: int = SHARDS,
) -> DataFrame:
    """How many words of each record the mix takes.

    Returns (key, size, source, source_size, target, taken, repeats, pieces), one row per input row;
    ``repeats`` is how often the block with the record's first word is taken, ``pieces`` an array of
    (shard, words): which shard gets how many of the record's words, for each of its blocks.  Null texts have
    size 0 and are taken 0 times; null sources form one source, last in order; repeated rows
    are records of their own; an empty table gives no rows; other columns are ignored.
    """
    zero = F.lit(0).cast("long")
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    rows = rows.groupBy("k", "source", "size").agg(F.count("*").alias("copies"))
    rows = checkpointed(rows.withColumn("u", unit_hash(seed, F.col("k"), F.col("size"))))
    sizes = checkpointed(
        rows.groupBy("source").agg(
            F.sum(F.col("size") * F.col("copies")).alias("source_size"),
            F.ceil(F.sqrt(F.count("*"))).cast("long").alias("buckets"),
        )
    )
    plan = source_plan(sizes, weights, blocks, repeat_limit).withColumnRenamed("source", "s")
    plan = plan.join(sizes.select("source", "buckets"), F.col("s").eqNullSafe(F.col("source"))).drop("source", "pieces")
    whole = F.greatest(F.col("n_blocks"), F.lit(1).cast("long"))
    steps = F.array(*[F.lit(p).cast("long") for p in STEPS])
    pick = F.pmod(unit_hash(f"{seed}:step", F.col("pos")), F.lit(len(STEPS))).cast("int")
    # a step that divides the number of blocks would not reach them all: the next one does
    prime = F.element_at(steps, pick + 1)
    prime = F.when(F.pmod(whole, prime) == 0, F.element_at(steps, F.pmod(pick + 1, F.lit(len(STEPS))) + 1)).otherwise(prime)
    plan = plan.withColumns(
        {
            "step": F.pmod(prime, whole),
            "shift": F.pmod(unit_hash(f"{seed}:shift", F.col("pos")), whole),
            "quotas": shard_quota(shards),
        }
    )
    plan = checkpointed(plan)
    if plan.count() <= 100_000:  # one short row a source: a few MB at this bound
        plan = F.broadcast(plan)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.floor(F.col("u") / F.lit(TWO52) * F.col("buckets")).cast("long"))
    before = Window.partitionBy("pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("pos", "bucket")
        .agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"))
        .select("pos", "bucket", F.coalesce(F.sum("tokens").over(before), zero).alias("start"))
    )
    inside = Window.partitionBy("pos", "bucket").orderBy("u", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), zero))
    rows = rows.join(starts, ["pos", "bucket"])
    one = F.lit(1).cast("long")
    nth = F.explode(F.sequence(zero, F.col("copies") - one)).alias("nth")
    rows = rows.select("*", nth).withColumn("begin", F.col("start") + F.col("offset") + F.col("nth") * F.col("size"))
    rows = rows.withColumn("pieces", F.when(F.col("size") > 0, pieces(repeat_limit, shards)).otherwise(F.array().cast("array<struct<shard: int, words: bigint>>")))
    first = F.filter(turns(F.col("begin") / F.col("block"), repeat_limit, shards), lambda t: t["taken"])
    return rows.select(
        F.col("k").alias(key),
        "size",
        F.col("source").alias(source),
        "source_size",
        "target",
        F.aggregate("pieces", zero, lambda a, p: a + p["words"]).alias("taken"),
        F.when(F.col("size") > 0, F.size(first).cast("long")).otherwise(zero).alias("repeats"),
        "pieces",
    )


def times_modulo(a: Column, b: Column, n: Column) -> Column:
    """a * b modulo n in BIGINT for a < 2**31 and b, n < 2**46."""
    high = F.pmod(a * F.shiftright(b, 16), n) * F.lit(1 << 16)
    return F.pmod(high + a * b.bitwiseAND(F.lit((1 << 16) - 1).cast("long")), n)


def turns(block: Column, repeat_limit: int, shards: int) -> Column:
    """For each pass over the source: the shard of the block's seat, and whether the shard's quota reaches to it."""
    n, s = F.greatest(F.col("n_blocks"), F.lit(1).cast("long")), F.lit(shards).cast("long")
    rank = F.pmod(times_modulo(F.col("step"), F.floor(block).cast("long"), n) + F.col("shift"), n)

    def turn(nth: int) -> Column:
        seat = rank + n * nth
        shard = F.pmod(F.col("first_seat") + seat, s).cast("int")
        # the seats of one shard are one in ``shards``, so this many come before
        before = (seat - F.pmod(seat, s)) / s
        return F.struct(shard.alias("shard"), (before < F.get("quotas", shard)).alias("taken"))

    return F.array(*[turn(nth) for nth in range(repeat_limit)])


def pieces(repeat_limit: int, shards: int) -> Column:
    """(shard, words) of the interval [begin, begin + size) under the plan's columns."""
    end = F.col("begin") + F.col("size")
    touched = F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((end - F.lit(1)) / F.col("block")))

    def of_block(block: Column) -> Column:
        words = F.least(end, (block + 1) * F.col("block")) - F.greatest(F.col("begin"), block * F.col("block"))
        seats = F.filter(turns(block, repeat_limit, shards), lambda t: t["taken"])
        return F.transform(seats, lambda t: F.struct(t["shard"].alias("shard"), words.alias("words")))

    return F.flatten(F.transform(touched, of_block))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "pieces")


#: The same mix in DuckDB: one ordered prefix sum a source, and all quotients in one list.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (
  SELECT source, source_size, pos, CAST([{", ".join(map(str, WEIGHTS))}][pos % {len(WEIGHTS)} + 1] AS DOUBLE) AS w, CAST({REPEAT_LIMIT} * source_size AS DOUBLE) AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source)
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), targets AS (
  SELECT s.*, least(cap, w * coalesce((SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, pos LIMIT 1), 0)) AS target FROM s
), sized AS (
  SELECT *, CAST(greatest(1, floor(least((SELECT sum(source_size) FROM s) / {BLOCKS}, coalesce((SELECT min(target) FROM targets WHERE target > 0), 1) / 100))) AS BIGINT) AS block FROM targets
), quotients AS (
  SELECT pos, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, pos, j) AS place
  FROM (SELECT pos, target, unnest(range(CAST((SELECT sum(source_size) FROM s) // block AS BIGINT))) AS j FROM sized WHERE target > 0)
), plan AS (
  SELECT z.*, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks, least(coalesce(won, 0), CAST(ceil(source_size / block) AS BIGINT) * {REPEAT_LIMIT}) AS quota
  FROM sized z LEFT JOIN (SELECT q.pos, count(*) AS won FROM quotients q JOIN sized z USING (pos) WHERE place <= (SELECT sum(source_size) FROM s) // block GROUP BY q.pos) USING (pos)
), ready AS (
  SELECT *, greatest(n_blocks, 1) AS whole, quota // greatest(n_blocks, 1) AS passes, quota % greatest(n_blocks, 1) AS rest,
    [{", ".join(map(str, STEPS))}][CAST('0x' || substr(md5('{SEED}:step:' || pos), 1, 13) AS BIGINT) % {len(STEPS)} + 1] % greatest(n_blocks, 1) AS step,
    CAST('0x' || substr(md5('{SEED}:shift:' || pos), 1, 13) AS BIGINT) % greatest(n_blocks, 1) AS shift
  FROM plan
), placed AS (
  SELECT d.doc_id, d.size, r.*, CAST(coalesce(sum(d.size) OVER (PARTITION BY pos ORDER BY CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.size), 1, 13) AS BIGINT), d.doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN ready r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE passes * size + coalesce(list_sum(list_transform(
    list_filter(range(start // block, (start + size - 1) // block + 1), lambda b: (step * b + shift) % whole < rest),
    lambda b: least(start + size, (b + 1) * block) - greatest(start, b * block))), 0) END AS BIGINT) AS taken,
  CAST(CASE WHEN size = 0 THEN 0 ELSE passes + CAST((step * (start // block) + shift) % whole < rest AS BIGINT) END AS BIGINT) AS repeats
FROM placed
"""
