"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... segments; a segment is summed up by its mean and its
standard deviation.  With them, Cauchy-Schwarz bounds the inner product from above (the
negated distance from below) by the sum over segments of
length * (mean_q * mean_x + dev_q * dev_x); finer levels, down to two components, only
tighten the bound.  Candidates are screened level by level, coarse to fine, against the
*floor* of each query, a score that k rows are known to reach; exact integer products are
computed for the survivors alone.

Floors are high from the start: a first round takes every query's exact k-th best among SEEDS
rows, those of largest norm, and within a block each query first meets the rows of highest
bound at a middle level.  Rows come in order of their norms, and a query leaves a block at the row whose
norm can no longer reach its floor.  Where the finest bound leaves many of some probed rows (vectors
without any structure, of which no bound can tell), all products are taken at once.

Queries and candidates meet in blocks of a fixed number of bytes: each pair of blocks is one
group of bounded size, whatever the dimension.  A group keeps k rows a query; a final window of
at most k rows a block and query picks the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import parallelism, table

SCALE = 1024
K = 10
#: Bytes of the queries and of the candidates that meet in one task: they bound its memory, not its result.
QUERY_BYTES = 4 << 20
ROW_BYTES = 16 << 20
#: Queries screened at a time within a task.
CHUNK = 128
#: Rows of the first round: those of largest norm, sent to every task.
SEEDS = 2048
#: Screening pays where the finest bound leaves at most this share of PROBED rows.
PAYS = 0.25
PROBED = 256
LIMIT = (1 << 63) - 1


def quantize(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as ARRAY<DOUBLE>; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def levels(dim: int) -> list[list[tuple[int, int]]]:
    """Segment limits of each resolution, coarse to fine, down to segments of two components."""
    out, parts = [], 1
    while parts <= max(1, dim // 2):
        cuts = [dim * i // parts for i in range(parts + 1)]
        out.append([(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a])
        parts *= 2
    return out


def statistics(x: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    """Per row: sqrt(length) * mean and sqrt(length) * deviation of each segment."""
    cols = []
    for a, b in segments:
        part = x[:, a:b]
        root = np.sqrt(b - a)
        cols += [part.mean(1) * root, part.std(1) * root]
    return np.stack(cols, 1)


def fits(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether sums of products of whole numbers are exact in DOUBLE, in any order."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2.0**53


def exact_products(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (qi, xi); values beyond 64 bits stop at their limits."""
    if fits(q, x):
        out = np.empty(len(qi), np.int64)
        for s in range(0, len(qi), 65536):
            out[s : s + 65536] = np.einsum("ij,ij->i", q[qi[s : s + 65536]], x[xi[s : s + 65536]])
        return out
    big = [[[int(v) for v in row] for row in m] for m in (q, x)]
    return np.array(
        [max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(big[0][i], big[1][j], strict=True)))) for i, j in zip(qi, xi, strict=True)],
        np.int64,
    )


class Best:
    """The k best (score descending, id ascending) of each query so far, and how many exact products that took."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * queries
        self.floor = np.full(queries, -np.inf) if floor is None else floor.astype(np.float64)
        self.exact = 0

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.rows[q][0], scores]), np.concatenate([self.rows[q][1], ids])
        order = np.lexsort((i, ~s))[: self.k]
        self.rows[q] = s[order], i[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], float(s[order[-1]]))


def search_block(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """Best candidates of a block of queries within a block of rows."""
    best = Best(len(qid), k, floor)
    norms = np.linalg.norm(x, axis=1) if x.shape[1] else np.zeros(len(xid))
    order = np.argsort(-norms, kind="stable")
    x, xid, norms = x[order], xid[order], norms[order]
    long = np.linalg.norm(q, axis=1) if q.shape[1] else np.zeros(len(qid))
    steps = [(statistics(q, seg), statistics(x, seg)) for seg in levels(q.shape[1])] if q.shape[1] else []
    for s in range(0, len(qid), CHUNK):
        _search_chunk(best, np.arange(s, min(s + CHUNK, len(qid))), qid, q, long, xid, x, norms, steps)
    return best


def _search_chunk(best, who, qid, q, long, xid, x, norms, steps) -> None:
    def take(qi: np.ndarray, xi: np.ndarray) -> None:
        """Exact products of pairs, sorted by query."""
        best.exact += len(qi)
        if len(qi) > 0.1 * len(who) * n and fits(q, x):
            # so many that a matrix product is cheaper; of a query's rows only those above its k-th best go on
            scores = np.full((len(who), n), -np.inf)
            scores[qi, xi] = (q[who] @ x[:n].T)[qi, xi]
            at = best.floor[who] if n <= best.k else np.maximum(best.floor[who], np.partition(scores, -best.k, axis=1)[:, -best.k])
            for j in range(len(who)):
                good = np.flatnonzero((scores[j] >= at[j]) & (scores[j] > -np.inf))
                if len(good):
                    best.add(who[j], scores[j, good].astype(np.int64), xid[good])
            return
        scores = exact_products(q, x, who[qi], xi)
        ends = np.searchsorted(qi, np.arange(len(who) + 1))
        for j in np.unique(qi):
            a, b = ends[j], ends[j + 1]
            best.add(who[j], scores[a:b], xid[xi[a:b]])

    # rows beyond the last whose norm can reach a query's floor are out
    slack = 1e-9 * long[who, None] * norms[None, :1] + 1e-6
    reach = np.searchsorted(-norms, -(best.floor[who] - slack[:, 0]) / np.maximum(long[who], 1e-300), side="right") if len(norms) else np.zeros(len(who), int)
    reach[best.floor[who] <= slack[:, 0]] = len(norms)
    n = int(reach.max(initial=0))
    if not n:
        return
    alive = (qid[who][:, None] != xid[None, :n]) & (np.arange(n)[None, :] < reach[:, None])
    allow = slack

    def promising(bound: np.ndarray) -> None:
        """Take the rows of highest bound at once: they raise the floors."""
        top = np.argpartition(-np.where(alive, bound, -np.inf), 2 * best.k, axis=1)[:, : 2 * best.k]
        done = np.zeros_like(alive)
        done[np.arange(len(who))[:, None], top] = True
        done &= alive
        take(*np.nonzero(done))
        alive[done] = False

    many = n > 4 * best.k
    if steps and many:
        known, own = steps[max(0, len(steps) - 2)]
        promising(known[who] @ own[:n].T)
    total = alive.size
    if steps and n > PROBED:
        some = np.arange(0, n, n // PROBED)
        passed = steps[-1][0][who] @ steps[-1][1][some].T + allow >= best.floor[who][:, None]
        if np.count_nonzero(passed & alive[:, some]) > PAYS * passed.size:
            steps = []
    for level, (known, own) in enumerate(steps, 1):
        left = np.count_nonzero(alive)
        if not left:
            return
        if left > 0.05 * total:
            bound = known[who] @ own[:n].T + allow
            if level == len(steps) and many:
                promising(bound)
            alive &= bound >= best.floor[who][:, None]
        else:
            qi, xi = np.nonzero(alive)
            for a in range(0, len(qi), 65536):
                e = slice(a, a + 65536)
                keep = np.einsum("ij,ij->i", known[who[qi[e]]], own[xi[e]]) + allow[qi[e], 0] >= best.floor[who[qi[e]]]
                alive[qi[e][~keep], xi[e][~keep]] = False
    take(*np.nonzero(alive))


def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows of one dimension."""
    flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t["id"].to_numpy(), flat.reshape(t.num_rows, -1) if t.num_rows else np.empty((0, 0))


def first_round(queries: DataFrame, rows: DataFrame, k: int, seeds: int) -> DataFrame:
    """Queries with ``floor``: their k-th best exact score among the ``seeds`` rows of largest norm, minus infinity below k.

    At most ``seeds`` rows go through the driver, a fixed number of bytes.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)
    top = rows.select("id", "v", norm.alias("norm")).orderBy(F.col("norm").desc(), "id").limit(seeds).select("id", "v").toArrow()
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.array([len(v) for v in top["v"]], int)
    for d in np.unique(sizes):
        by[int(d)] = matrix(top.filter(pa.array(sizes == d)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            found = np.full(len(dims), -np.inf)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                qid, q = matrix(pa.Table.from_batches([batch]).take(pa.array(at)))
                xid, x = by.get(int(d), (np.empty(0, np.int64), None))
                if len(xid) > k and d:
                    for s in range(0, len(at), 512):
                        score = q[s : s + 512] @ x.T
                        score[qid[s : s + 512, None] == xid[None, :]] = -np.inf
                        best = np.partition(score, -k, axis=1)[:, -k]
                        # rounding of sums beyond 53 bits
                        found[at[s : s + 512]] = best - 1e-9 * np.abs(best)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "floor"])

    return queries.mapInArrow(floors, "id long, v array<double>, dim int, qb int, floor double")


def top_k(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    is_query: Column | None = None,
    k: int = K,
    query_bytes: int = QUERY_BYTES,
    row_bytes: int = ROW_BYTES,
    seeds: int = SEEDS,
) -> DataFrame:
    """The k rows of highest integer inner product with each query: (query_id, rank, vec_id, score).

    ``is_query`` marks the query rows (default: keys divisible by 100).  Ranks start at 1; ties
    go to the smaller key.  Vectors that are null or hold a null or a non-finite component take
    no part, nor do rows without a key; vectors of another length than the query's are no
    candidates; rows with the query's own key are none either; repeated query rows count once,
    repeated candidates each.  Fewer than k candidates give all; an empty table gives no rows;
    other columns are ignored.
    """
    spark = rows.sparkSession
    marked = F.pmod(F.col(key), F.lit(100)) == 0 if is_query is None else is_query
    good = rows.select(F.col(key).cast("long").alias("id"), quantize(F.col(vector)).alias("v"), marked.alias("q")).where(
        "id is not null and v is not null"
    )
    counts = good.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("dim")).first()
    wide = 8 * max(1, counts["dim"] or 1)
    n_x = max(1, min(4 * parallelism(spark), -(-counts["n"] // 256)), -(-counts["n"] * wide // row_bytes))
    n_q = max(1, -(-counts["q"] * wide // query_bytes))
    hashed = F.xxhash64("id", "v")
    own = good.where("q").dropDuplicates(["id", "v"]).select("id", "v", F.size("v").alias("dim"), F.pmod(hashed, F.lit(n_q)).cast("int").alias("qb"))
    floors = first_round(own, good, k, min(seeds, row_bytes // wide))
    queries = floors.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))).alias("xb"))
    candidates = good.select("id", "v", F.size("v").alias("dim"), F.pmod(hashed, F.lit(n_x)).cast("int").alias("xb")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb")
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            qid, q = matrix(left)
            best = search_block(qid, q, *matrix(right), k, left["floor"].to_numpy())
            for i, (s, x) in zip(qid, best.rows, strict=True):
                out[0].append(np.full(len(s), i))
                out[1].append(x)
                out[2].append(s)
        cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    keys = ["qb", "xb", "dim"]
    local = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: Read with DuckDB over the same table.
OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v x ON x.vec_id <> q.vec_id AND len(x.v) = len(q.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
