"""Full-text (BM25), vector and hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import python_tokens, tokens
from ..functions.vector import distance, literal, wide

K1, B = 1.5, 0.75
RRF = 60


TEXT_COLUMNS = ("input_text", "output_text", "span_name", "agent_name", "tool_name", "model")


def event_text(columns: Sequence[str] = TEXT_COLUMNS) -> Column:
    """What of an event is searched: its texts and names, then its logs."""
    logs = F.coalesce(F.array_join("logs", " "), F.lit(""))
    return F.concat_ws(" ", *columns, F.when(logs != "", logs))


def span_documents(events: DataFrame) -> DataFrame:
    """One document a span: the texts of its events, each event identity once."""
    for c in TEXT_COLUMNS:
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    return events.groupBy("trace_id", "span_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", event_text().alias("t")))), lambda x: x["t"]), " ").alias("text")
    )


def postings(docs: DataFrame, key: Sequence[str], text: str = "text", tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, token, tf, doc_len) of every document; write it out once to search a corpus often."""
    cut = docs.select(*key, tokenize(F.col(text)).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))
    return cut.select(*key, "doc_len", F.explode("tokens").alias("token")).groupBy(*key, "token", "doc_len").agg(F.count("*").alias("tf"))


def _count(array: str, token: str) -> Column:
    return F.size(F.filter(array, lambda x: x == token))


def bm25(
    docs: DataFrame,
    query: str,
    key: Sequence[str],
    k: int | None = 10,
    text: str = "text",
    matching: Column | None = None,
    tokenize: Callable[[Column], Column] = tokens,
    query_tokens: list[str] | None = None,
) -> DataFrame:
    """The k best documents: (key, score), score descending, key ascending.

    Statistics are those of the whole corpus; ``matching`` filters afterwards.  Each text is cut
    once: only its length and the query's term counts leave the scan, and the statistics and the
    scores read one exchange of those narrow rows.
    """
    terms = sorted(set(python_tokens(query) if query_tokens is None else query_tokens))
    extra = [] if matching is None else [matching.alias("__match")]
    cut = docs.select(*key, *extra, tokenize(F.col(text)).alias("__t"))
    tf = [_count("__t", t).alias(f"tf_{i}") for i, t in enumerate(terms)]
    kept = [*key, *(["__match"] if extra else [])]
    # both readers need these columns for the dealing, so they share one exchange of narrow rows
    narrow = cut.select(*kept, F.size("__t").alias("dl"), *tf).repartition(*kept)
    stats = narrow.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]
    )
    scored = narrow.crossJoin(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(terms)):
        df, f = F.col(f"df_{i}"), F.col(f"tf_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        norm = 1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))
        parts.append(F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * norm)).otherwise(F.lit(0.0)))
    score = sum(parts, F.lit(0.0))
    found = scored.withColumn("score", score).where("score > 0")
    if matching is not None:
        found = found.where("__match")
    found = found.select(*key, "score")
    return found if k is None else found.orderBy(F.col("score").desc(), *key).limit(k)


def bm25_from_postings(posted: DataFrame, lengths: DataFrame, query: str, key: Sequence[str], k: int = 10) -> DataFrame:
    """The same scores from written postings; ``lengths`` has (key, doc_len) of every document."""
    terms = sorted(set(python_tokens(query)))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
    hits = posted.where(F.col("token").isin(terms))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl"))
    scored = hits.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))
    # a term's part is one row of a document; parts are added in the order of the terms, as ``bm25`` does, so equal documents tie exactly
    parts = [F.coalesce(F.max(F.when(F.col("token") == t, idf * F.col("tf") * (K1 + 1) / norm)), F.lit(0.0)) for t in terms]
    return scored.groupBy(*key).agg(sum(parts, F.lit(0.0)).alias("score")).orderBy(F.col("score").desc(), *key).limit(k)


def substring_score(text: Column, query: str) -> Column:
    """How many of the query's words a text contains."""
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in query.split()), F.lit(0))


def knn(
    vectors: DataFrame, query: Sequence[float], key: Sequence[str], k: int = 10, vector: str = "embedding", metric: str = "l2", matching: Column | None = None
) -> DataFrame:
    """The k nearest vectors: (key, distance); the filter comes first, so results stay exact. Other dimensions are left out."""
    pool = vectors if matching is None else vectors.where(matching)
    pool = pool.where(F.size(vector) == len(query))
    found = pool.select(*key, distance(wide(F.col(vector)), literal(query), metric).alias("distance"))
    return found.orderBy("distance", *key).limit(k)


def ranked(df: DataFrame, order: Sequence[Column], key: Sequence[str]) -> DataFrame:
    """Ranks from 1 of a short list."""
    return df.select(*key, F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(rankings: Sequence[DataFrame], key: Sequence[str], k: int = 10, c: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists; ties go to the smaller key."""
    union = rankings[0]
    for r in rankings[1:]:
        union = union.unionByName(r)
    return union.groupBy(*key).agg(F.sum(1.0 / (c + F.col("rank"))).alias("score")).orderBy(F.col("score").desc(), *key).limit(k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, key: Sequence[str], k: int = 10) -> DataFrame:
    """Both sides give max(k, 10) hits; their ranks are fused."""
    pool = max(k, 10)
    left = ranked(text_hits.limit(pool), [F.col("score").desc(), *map(F.col, key)], key)
    right = ranked(vector_hits.limit(pool), [F.col("distance"), *map(F.col, key)], key)
    return fuse([left, right], key, k)


def search_mode(text: str | None, vector: Sequence[float] | None) -> str:
    if vector is not None:
        return "hybrid" if text else "vector"
    return "text"


def request_mode(request: dict, embed: Callable[[str], Sequence[float]] | None = None) -> tuple[str | None, Sequence[float] | None]:
    """Text and vector that a request asks for: a given vector wins, semantic modes embed the text, hybrid keeps both."""
    text, vector, mode = request.get("text"), request.get("vector"), request.get("mode")
    if isinstance(vector, list | tuple):
        return text, vector
    if mode in ("semantic", "vector", "hybrid") or vector == "auto":
        if not text:
            raise ValueError("this mode needs a text")
        if embed is None:
            raise ValueError("this mode needs an embedder")
        return (text if mode == "hybrid" or vector == "auto" else None), embed(text)
    return text, None


def materialize(hits: DataFrame, spans: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hits with their spans, rank kept; hits whose span is not visible drop out.  Spark broadcasts the hits if it finds them small."""
    return hits.join(spans, list(key))


#: Cells of the codebook, and how many of them a search opens.
CELLS = 16
PROBES = 12


class InvertedFile:
    """Approximate search: vectors in cells of a sampled codebook, the nearest cells searched exactly.

    The codebook is fitted on at most ``sample`` vectors; every vector is indexed.  Null vectors, and those
    of another length or with null components, are in no cell; an empty table has no cells and no hits.
    """

    def __init__(self, centers: np.ndarray):
        self.centers = centers

    @classmethod
    def fit(cls, vectors: DataFrame, vector: str = "embedding", cells: int = CELLS, sample: int = 4096, seed: int = 1) -> InvertedFile:
        rows = vectors.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector)).limit(sample).toArrow()
        good = [v for v in rows[vector].to_pylist() if None not in v]
        x = np.array([v for v in good if len(v) == len(good[0])], np.float64)
        if not len(x):
            return cls(np.empty((0, 0)))
        rng = np.random.default_rng(seed)
        centers = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(10):
            near = ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
            centers = np.stack([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centers)])
        return cls(centers)

    def index(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        centers = self.centers

        @F.arrow_udf("int")
        def cell(v: pa.Array) -> pa.Array:
            rows = v.to_pylist()
            fits = [i for i, x in enumerate(rows) if x is not None and len(x) == centers.shape[1] and None not in x] if len(centers) else []
            found: list[int | None] = [None] * len(rows)
            if fits:
                x = np.array([rows[i] for i in fits], np.float64)
                for i, c in zip(fits, ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1).tolist(), strict=True):
                    found[i] = c
            return pa.array(found, pa.int32())

        return vectors.withColumn("cell", cell(F.col(vector)))

    def search(self, indexed: DataFrame, query: Sequence[float], key: Sequence[str], k: int = 10, probes: int = PROBES, vector: str = "embedding") -> DataFrame:
        order = ((self.centers - np.array(query)) ** 2).sum(1).argsort()[:probes] if len(self.centers) else []
        return knn(indexed, query, key, k, vector, matching=F.col("cell").isin([int(c) for c in order]))
