"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Shingles are five consecutive words; two texts are linked when the Jaccard similarity of
their shingle sets is at least 0.8.

1. Documents with equal shingle sets are one *set* from here on; sets carry how many
   documents they stand for, so copies are never paired.
2. BANDS keys of ROWS MinHash values each give candidates: sets with a key in common are in one
   *bucket*.  No pairs are made of a bucket.  Each set knows the least set of each of its buckets
   (BANDS at most) and is tied to the least of these; what is left to connect are those least
   sets, few and distinct, whose components are the *areas*.  All candidates of a set are in
   its area.  A pair at the threshold shares no key with probability below 2e-5.
3. An area of at most BLOCK sets, nearly every one, is compared in one piece.  A larger one is
   cut by size class, a class reaching as far as one size can be linked to another, and classes
   into blocks of BLOCK sets, or fewer where texts are long.  First each block is compared with
   itself, then with the later blocks of its own class and those of the next: pieces of bounded size,
   whatever the size of the area.  The text of a set is fetched by hashes of one row's key and
   text, so a key that many rows share meets its own text alone.
4. There, pairs compare their MinHash values chunk by chunk.  With a uniform prior, m matches
   among n give the posterior P(J >= t) = P(Bin(n + 1, t) <= m); a pair is dropped as soon as it
   falls below ``tolerance``.  What is left is verified exactly on the shingle sets.
5. A block compared with itself gives each set its root and its link counts.  Blocks compared with others
   add to the counts, and of links they keep a spanning forest over roots alone; the components
   of these few edges give the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, parallelism, table
from .graph import components

WORDS = 5
THRESHOLD = 0.8
ROWS = 6
BANDS = 36
BLOCK = 512
#: Shingles of a block, about: blocks of long texts hold fewer sets.
BLOCK_SHINGLES = 1 << 21
#: Later blocks that one piece of work compares a block with.
REACH = 8
CHUNK = 24
TOLERANCE = 1e-9
SPACES = bytes([9, 10, 11, 12, 13])
_BLANKS = bytes.maketrans(SPACES, b" " * len(SPACES))
STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    n = ROWS * BANDS
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


class Shingler:
    """Shingle sets of texts, as sorted arrays of 64-bit hashes; remembers the hashes of words seen."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_BLANKS).split(b" ")
        words = [w for w in words if w]
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        try:
            h = [known[w] for w in words]
        except KeyError:
            h = []
            for w in words:
                v = known.get(w)
                if v is None:
                    v = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                h.append(v)
        c = np.array(h, np.uint64)
        n = min(WORDS, len(c))
        g = np.zeros(len(c) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                g = (g ^ (g >> np.uint64(31))) * STEP + c[j : len(c) - n + 1 + j]
            g ^= g >> np.uint64(32)
            g *= STEP
            g ^= g >> np.uint64(29)
        return np.unique(g)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty shingle set."""
    a, b = _permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for s in range(0, len(x), 512):
            h = x[s : s + 512, None] * a
            h += b
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            np.minimum(out, h.min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            h = (h ^ (h >> np.uint64(29))) * STEP + rows[:, j]
        h = (h ^ (h >> np.uint64(32))) * STEP
    return h.astype(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=12).digest()


@lru_cache(maxsize=8)
def fewest_matches(threshold: float, tolerance: float, total: int, chunk: int) -> tuple[int, ...]:
    """For 1, 2, ... chunks compared: the fewest matches whose posterior of reaching the threshold is at least the tolerance."""
    out = []
    for n in [*range(chunk, total, chunk), total]:
        cdf, m = 0.0, -1
        while cdf < tolerance and m < n:
            m += 1
            cdf += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(max(0, m))
    return tuple(out)


def linked_pairs(
    sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (one of left, one of right) with similarity of at least the threshold."""
    total = sigs.shape[1]
    least = fewest_matches(threshold, tolerance, total, CHUNK)
    sizes = np.array([len(s) for s in sets])
    first_i, first_j, counts = [], [], []
    for s in range(0, len(left), 64):
        part = left[s : s + 64]
        match = np.zeros((len(part), len(right)), np.uint8)
        for c in range(CHUNK):
            match += sigs[part, c][:, None] == sigs[right, c][None, :]
        ok = match >= least[0]
        if same:
            ok &= part[:, None] < right[None, :]
        a, b = sizes[part][:, None], sizes[right][None, :]
        ok &= np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
        i, j = np.nonzero(ok)
        first_i.append(part[i])
        first_j.append(right[j])
        counts.append(match[i, j].astype(np.int32))
    i, j, m = np.concatenate(first_i), np.concatenate(first_j), np.concatenate(counts)
    for n, c in enumerate(range(CHUNK, total, CHUNK), 1):
        if not len(i):
            break
        keep = np.empty(len(i), bool)
        for s in range(0, len(i), 100_000):
            e = slice(s, s + 100_000)
            m[e] += (sigs[i[e], c : c + CHUNK] == sigs[j[e], c : c + CHUNK]).sum(1)
            keep[e] = m[e] >= least[n]
        i, j, m = i[keep], j[keep], m[keep]
    if not len(i):
        return i, j
    both = intersections(sets, i, j)
    # |A & B| / |A | B| >= t, in whole numbers as far as they go
    ok = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    return i[ok], j[ok]


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the pairs' common parts."""
    if len(i) < 2000:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    # many pairs of few sets: one matrix product over the shingles that two sets at least share
    used = np.unique(np.concatenate([i, j]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    flat = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[col.ravel()] > 1
    row, col = row[shared], np.unique(col.ravel()[shared], return_inverse=True)[1].ravel()
    width = int(col.max(initial=-1)) + 1
    total = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for s in range(0, width, 4096):
        a, b = np.searchsorted(col, [s, s + 4096])
        m = np.zeros((len(used), min(4096, width - s)), np.float32)
        m[row[a:b], col[a:b] - s] = 1
        total += m @ m.T
    return np.rint(total[place[i], place[j]]).astype(np.int64)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Block:
    """Sets of one block: keys, copies, shingles and MinHash values, and the roots that are known of them."""

    def __init__(self, rows: list[dict], shingle: Shingler):
        found = {}
        for r in rows:
            shingles = shingle(r["t"])
            if set_key(shingles) == r["s"]:  # another text may have the same hashes
                found[r["s"]] = (shingles, r)
        self.keys = sorted(found)
        self.shingles = [found[k][0] for k in self.keys]
        self.copies = np.array([found[k][1]["copies"] for k in self.keys], np.int64)
        self.sigs = np.stack([np.frombuffer(found[k][1]["sig"], np.uint32) for k in self.keys]) if found else np.empty((0, 1), np.uint32)
        self.roots = [found[k][1].get("root") for k in self.keys]
        self.n_sets, self.n_docs = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)

    def count(self, i: np.ndarray, copies: np.ndarray) -> None:
        self.n_sets += np.bincount(i, minlength=len(self.keys))
        self.n_docs += np.bincount(i, copies, len(self.keys)).astype(np.int64)


def links_within(block: Block, threshold: float, tolerance: float) -> list[bytes]:
    """The root of each set among the links of its own block, which are counted."""
    forest = Forest(len(block.keys))
    if len(block.keys) > 1:
        everyone = np.arange(len(block.keys))
        i, j = linked_pairs(block.shingles, block.sigs, everyone, everyone, True, threshold, tolerance)
        block.count(i, block.copies[j])
        block.count(j, block.copies[i])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            forest.join(a, b)
    return [block.keys[forest.root(x)] for x in range(len(block.keys))]


def links_between(left: Block, right: Block, threshold: float, tolerance: float) -> set[tuple[bytes, bytes]]:
    """Pairs of roots with a link between two blocks; all links are counted."""
    n = len(left.keys)
    if not n or not right.keys:
        return set()
    here, there = np.arange(n), n + np.arange(len(right.keys))
    i, j = linked_pairs(left.shingles + right.shingles, np.concatenate([left.sigs, right.sigs]), here, there, False, threshold, tolerance)
    j = j - n
    left.count(i, right.copies[j])
    right.count(j, left.copies[i])
    return {(left.roots[a], right.roots[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)}


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Class and links of every document: (key, class_id, n_links, n_text_links, n_copies).

    ``class_id`` is the least key among the documents connected by links; ``n_links`` the number of
    other documents with a similarity of at least the threshold, copies included; ``n_text_links``
    the linked shingle sets other than the own; ``n_copies`` the documents with the own set.
    Words are runs of non-blank characters; a text of fewer than five words is one shingle.
    Null and empty texts have no shingles, no links and are their own class (with their own key);
    repeated rows are copies of each other; null keys take part, and name a class only if no other
    key does; an empty table gives no rows; other columns are ignored.  Thresholds below THRESHOLD,
    for which the fixed bands would lose links, are refused.
    """
    if not THRESHOLD <= threshold <= 1:
        raise ValueError(f"threshold {threshold} is not between {THRESHOLD} and 1: {BANDS} bands of {ROWS} rows would lose links")
    spark = docs.sparkSession
    slim = docs.select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")
    )
    key_type = slim.schema["k"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            keys, bands, sizes = [], [], []
            for t in batch["t"].to_pylist():
                s = shingle(t)
                keys.append(set_key(s) if len(s) else None)
                bands.append(band_keys(signature(s)).tobytes() if len(s) else None)
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [batch["k"], batch["h1"], batch["h2"], pa.array(keys, pa.binary()), pa.array(bands, pa.binary()), pa.array(sizes, pa.int64())],
                names=["k", "h1", "h2", "s", "bands", "shingles"],
            )

    sketched = checkpointed(slim.mapInArrow(sketch, f"k {key_type}, h1 long, h2 long, s binary, bands binary, shingles long"))
    sets = (
        sketched.where("s is not null").groupBy("s")
        .agg(
            F.min(F.struct(F.isnull("k"), "k", "h1", "h2")).alias("row"), F.count("*").alias("copies"),
            F.first("bands").alias("bands"), F.first("shingles").alias("shingles"),
        )
        .select("s", F.col("row.k").alias("least"), "row.h1", "row.h2", "copies", "bands", "shingles")
    )
    sets = checkpointed(sets)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch["bands"].to_pylist()), np.int64)
            who = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch["s"].take(pa.array(who))], names=["band", "s"])

    in_bands = sets.select("s", "bands").mapInArrow(spread, "band long, s binary")
    buckets = in_bands.groupBy("band").agg(F.count("*").alias("n"), F.min("s").alias("center")).where("n > 1")
    # at most BANDS centers a set, the least of which it is tied to
    tied = (
        in_bands.join(buckets.select("band", "center"), "band")
        .groupBy("s").agg(F.array_sort(F.collect_set("center")).alias("centers"))
        .select("s", "centers", F.get("centers", F.lit(0)).alias("rep"))
    )
    tied = checkpointed(tied)
    between = tied.where(F.size("centers") > 1).select(F.col("rep").alias("a"), F.explode(F.slice("centers", 2, BANDS)).alias("b")).distinct()
    areas = components(between)
    placed = tied.join(areas, F.col("rep") == F.col("node"), "left").select("s", F.coalesce("label", "rep").alias("label"))

    # sizes that can be linked differ by one class at most
    size_class = F.floor(F.log("shingles") / F.lit(log(1 / threshold) + 1e-9)).cast("long")
    members = checkpointed(placed.join(sets, "s").select("label", "s", "least", "h1", "h2", "copies", "shingles", size_class.alias("c")))
    load = lambda n, m: F.ceil(F.greatest(n / BLOCK, m / BLOCK_SHINGLES)).cast("long")
    # counted by size class first: one row a class and area, a class for each factor of 1 / threshold
    per_class = members.groupBy("label", "c").agg(F.count("*").alias("n"), F.sum("shingles").alias("m"))
    cuts = per_class.groupBy("label").agg(
        load(F.sum("n"), F.sum("m")).alias("load"), F.map_from_entries(F.collect_list(F.struct("c", load(F.col("n"), F.col("m"))))).alias("cuts")
    )
    cuts = cuts.where("load > 1").select("label", "cuts")
    none = F.lit(0).cast("long")
    blocks = {n: F.coalesce(F.col("cuts")[F.col("c") + F.lit(d).cast("long")], none) for n, d in (("before", -1), ("own", 0), ("after", 1))}
    chosen = members.join(cuts, "label", "left").select(
        "label", "s", "h1", "h2", "copies",
        F.when(F.col("cuts").isNull(), none).otherwise(F.col("c")).alias("c"),
        F.when(F.col("cuts").isNull(), none).otherwise(F.pmod(F.xxhash64("s"), F.col("cuts")[F.col("c")])).alias("b"),
        *[v.alias(n) for n, v in blocks.items()],
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            found = [shingle(t) for t in batch["t"].to_pylist()]
            sigs = pa.array([signature(s).tobytes() if len(s) else None for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, sigs], names=[*batch.schema.names, "sig"])

    fetched = (
        slim.select("h1", "h2", "t").join(chosen, ["h1", "h2"])
        .dropDuplicates(["h1", "h2"])  # repeated rows; dealt as the join is
        .drop("h1", "h2")
    )
    fetched = fetched.mapInArrow(sign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fetched.schema) + ", sig binary")
    fetched = checkpointed(fetched)
    n = max(parallelism(spark), 1)

    def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
        rows = (row for batch in batches for row in batch.to_pylist())
        return groupby(rows, lambda r: tuple(r[k] for k in keys))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for _, rows in grouped(batches, ["label", "c", "b"]):
            block = Block(list(rows), shingle)
            roots = links_within(block, threshold, tolerance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.keys, pa.binary()), pa.array(roots, pa.binary()), pa.array(block.n_sets), pa.array(block.n_docs)],
                names=["s", "root", "n_sets", "n_docs"],
            )

    own = fetched.select("label", "c", "b", "s", "copies", "t", "sig").repartition(n, "label", "c", "b").sortWithinPartitions("label", "c", "b")
    inner = checkpointed(own.mapInArrow(within, "s binary, root binary, n_sets long, n_docs long"))

    # a block of a large area meets the later ones of its class and those of the next, REACH at a time
    c, b = F.col("c"), F.col("b")
    later = F.col("own") - 1 - b + F.col("after")
    piece = lambda lc, li, nth, side: F.struct(
        lc.alias("lc"), li.alias("li"), F.floor(nth / REACH).cast("long").alias("part"), F.lit(side).alias("side")
    )
    empty = F.array().cast("array<struct<lc: bigint, li: bigint, part: bigint, side: int>>")
    upto = lambda m, f: F.when(m > 0, F.transform(F.sequence(none, m - F.lit(1).cast("long")), f)).otherwise(empty)
    meets = F.concat(
        upto(F.ceil(later / REACH).cast("long"), lambda p: piece(c, b, p * REACH, 0)),
        upto(b, lambda i: piece(c, i, b - i - 1, 1)),
        upto(F.col("before"), lambda i: piece(c - 1, i, F.col("before") - 1 - i + b, 1)),
    )
    across = (
        fetched.where("own > 0").join(inner.select("s", "root"), "s")
        .select("label", F.inline(meets), "c", "b", "s", "copies", "root", "t", "sig")
        .repartition(n, "label", "lc", "li", "part").sortWithinPartitions("label", "lc", "li", "part", "side", "c", "b")
    )

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()

        def counts(block: Block) -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(block.n_sets)
            if len(some):
                keys = pa.array([block.keys[x] for x in some], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.nulls(len(some), pa.binary()), pa.array(block.n_sets[some]), pa.array(block.n_docs[some])], names=["s", "root", "n_sets", "n_docs"]
                )

        for _, rows in grouped(batches, ["label", "lc", "li", "part"]):
            left = Block([], shingle)
            number: dict[bytes, int] = {}
            forest = Forest(0)
            edges = []
            for (side, *_), block_rows in groupby(rows, lambda r: (r["side"], r["c"], r["b"])):
                block = Block(list(block_rows), shingle)
                if side == 0:
                    left = block
                    continue
                for x, y in sorted(links_between(left, block, threshold, tolerance)):
                    for r in (x, y):
                        if r not in number:
                            number[r] = forest.add()
                    if forest.join(number[x], number[y]):
                        edges.append((x, y))
                yield from counts(block)
            yield from counts(left)
            if edges:
                zeros = pa.array(np.zeros(len(edges), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in edges], pa.binary()), pa.array([y for _, y in edges], pa.binary()), zeros, zeros], names=["s", "root", "n_sets", "n_docs"]
                )

    outer = checkpointed(across.mapInArrow(beyond, "s binary, root binary, n_sets long, n_docs long"))
    classes = components(outer.where("root is not null").select(F.col("s").alias("a"), F.col("root").alias("b")))
    linked = (
        inner.union(outer.where("root is null")).groupBy("s")
        .agg(F.max("root").alias("root"), F.sum("n_sets").alias("n_sets"), F.sum("n_docs").alias("n_docs"))
        .join(classes, F.col("root") == F.col("node"), "left")
        .join(members.select("s", "least"), "s")
        .select("s", "least", F.coalesce("label", "root").alias("label"), "n_sets", "n_docs")
    )
    linked = checkpointed(linked)
    heads = linked.groupBy("label").agg(F.min("least").alias("class_id"))
    known = sets.select("s", "least", "copies").join(linked.join(heads, "label").select("s", "class_id", "n_sets", "n_docs"), "s", "left")
    known = known.select("s", "copies", "n_sets", "n_docs", F.coalesce("class_id", "least").alias("class_id"))
    zero = F.lit(0).cast("long")
    out = sketched.select("k", "s").join(known, "s", "left")
    return out.select(
        F.col("k").alias(key),
        F.when(F.col("s").isNull(), F.col("k")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("s").isNull(), zero).otherwise(F.coalesce("n_docs", zero) + F.col("copies") - F.lit(1).cast("long")).alias("n_links"),
        F.coalesce("n_sets", zero).alias("n_text_links"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
    )


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
