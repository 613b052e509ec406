"""Language identification with interpolated Kneser-Ney character models.

One model a language, of order 4 over lower-cased letters (anything else is one blank).
The models are kept in arrays sorted by n-gram hash with one column a language: the
log-probability of every n-gram that any language has seen, and the back-off weight of every
context.  A text gets the language of lowest cross-entropy per character over its whole length.

Fitting reads a bounded sample of labelled rows: ``max_chars`` in all, of each row a window of at most
``longest`` characters, of at most ``max_langs`` languages.  N-grams are counted
in the cluster and the counts, bounded by the sample, are smoothed on the driver; a model of more
than ``max_model_bytes`` is fitted again on half the sample, so what is broadcast is bounded.  Rejection
limits are calibrated on another fold: the entropy that all but ``reject`` of a language's
own documents stay below.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import table

ORDER = 4
MAX_CHARS = 12_000_000
LONGEST = 100_000
MAX_LANGS = 256
MAX_MODEL_BYTES = 512 << 20
REJECT = 0.005
UND = "und"
BLANK, EDGE = 32, 1
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts scored together, in characters.
BATCH = 1_000_000


def fold_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to its lower-case letter, or to the blank; combining marks are part of words and stay."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif c > 0x2FF and unicodedata.category(ch)[0] == "M":
            out[c] = c
    return out


@lru_cache(maxsize=1)
def marks() -> np.ndarray:
    """Whether a symbol is a combining mark: a text of these alone has no letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)


def has_letter(s: np.ndarray) -> bool:
    s = s[s > BLANK]
    return len(s) > 0 and not marks()[s].all()


def symbols(text: str) -> np.ndarray:
    """The text as letters with single blanks, after ORDER - 1 edge symbols."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    s = letters()[raw]
    if len(s):
        blank = s == BLANK
        blank[1:] &= s[:-1] == BLANK
        blank[0] = s[0] == BLANK
        s = s[~blank]
    return np.concatenate([np.full(ORDER - 1, EDGE, np.uint32), s])


def hashes(s: np.ndarray) -> list[np.ndarray]:
    """For each length 1..ORDER, the hash of the n-gram that ends at each place (wrong in the first places)."""
    c = s.astype(np.uint64)
    out, power = [c], np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER):
            power = power * STEP
            h = out[-1].copy()
            h[n:] += c[:-n] * power
            out.append(h)
    return out


class Model:
    """Sorted hash arrays: per order, n-grams with log-probabilities and contexts with log back-off weights."""

    def __init__(self, langs, grams, limits=None):
        self.langs, self.grams, self.limits = langs, grams, limits or {}

    def size(self) -> int:
        return sum(a.nbytes for level in self.grams.values() for a in level)

    def log_probabilities(self, s: np.ndarray) -> np.ndarray:
        """log p of each symbol of a text after its context, a column a language."""
        h = hashes(s)
        out = np.zeros((len(s), len(self.langs)), np.float32)
        left = np.arange(len(s))
        for n in range(ORDER, 0, -1):
            keys, logp, contexts, backoff = self.grams[n]
            at = h[n - 1][left]
            i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
            hit = keys[i] == at
            out[left[hit]] += logp[i[hit]]
            left = left[~hit]
            if not len(left):
                break
            if n == 1:
                out[left] += backoff[0]  # a symbol that no language has seen
                break
            at = h[n - 2][np.maximum(left - 1, 0)]
            i = np.minimum(np.searchsorted(contexts, at), len(contexts) - 1)
            known = contexts[i] == at
            out[left[known]] += backoff[i[known]]
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each text, a column a language; nan where a text has no letter."""
        parts = [symbols(t) for t in texts]
        out = np.full((len(parts), len(self.langs)), np.nan)
        has = [i for i, p in enumerate(parts) if has_letter(p)]
        if not has:
            return out
        for a, b in _runs([len(parts[i]) for i in has], BATCH):
            chosen = has[a:b]
            s = np.concatenate([parts[i] for i in chosen])
            lengths = np.array([len(parts[i]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            score = self.log_probabilities(s).astype(np.float64)
            score[s == EDGE] = 0
            sums = np.add.reduceat(score, starts, axis=0)
            out[chosen] = -sums / (lengths - (ORDER - 1))[:, None]
        return out


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    yield a, len(sizes)


def smooth(langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]) -> Model:
    """Interpolated Kneser-Ney from each language's ORDER-gram counts (rows of symbols, and how often)."""
    step = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in range(ORDER):
            step.append(step[-1] * STEP)

        def hashed(g: np.ndarray) -> np.ndarray:
            h = np.zeros(len(g), np.uint64)
            for j in range(g.shape[1]):
                h += g[:, g.shape[1] - 1 - j].astype(np.uint64) * step[j]
            return h

        levels: dict[int, list] = {}
        for g, c in zip(grams, counts, strict=True):
            c = c.astype(np.float64)
            for n in range(ORDER, 0, -1):
                levels.setdefault(n, []).append((g, c))
                # continuation counts: in how many different longer n-grams an n-gram ends
                if n > 1:
                    g, inverse = np.unique(g[:, 1:], axis=0, return_inverse=True)
                    c = np.bincount(inverse.ravel()).astype(np.float64)
        alphabet = len(np.unique(np.concatenate([lv[0][:, 0] for lv in levels[1]]))) + 1
        below_keys = below = None
        below_back = np.full((1, len(langs)), 1.0 / alphabet)
        out = {}
        for n in range(1, ORDER + 1):
            union, where = np.unique(np.concatenate([g for g, _ in levels[n]]), axis=0, return_inverse=True)
            where = where.ravel()
            contexts, of = np.unique(union[:, :-1], axis=0, return_inverse=True)
            of = of.ravel()
            c = np.zeros((len(union), len(langs)))
            a = 0
            for k, (g, cs) in enumerate(levels[n]):
                c[where[a : a + len(g)], k] = cs
                a += len(g)
            ones, twos = (c == 1).sum(0), (c == 2).sum(0)
            d = np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
            d = np.clip(d, 0.1, 0.95)
            total = np.zeros((len(contexts), len(langs)))
            types = np.zeros_like(total)
            np.add.at(total, of, c)
            np.add.at(types, of, c > 0)
            back = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
            if n == 1:
                lower = np.broadcast_to(below_back, c.shape)
            else:
                # every n-gram's ending was counted one order below
                lower = below[np.searchsorted(below_keys, hashed(union[:, 1:]))]
            p = np.maximum(c - d, 0) / np.maximum(total[of], 1) + back[of] * lower
            keys = hashed(union)
            order = np.argsort(keys)
            below_keys, below = keys[order], p[order]
            if n == 1:
                log_back, ctx = np.log(back * below_back), np.zeros(1, np.uint64)
            else:
                ctx = hashed(contexts)
                by = np.argsort(ctx)
                ctx, log_back = ctx[by], np.log(back[by])
            out[n] = (below_keys, np.log(below).astype(np.float32), ctx, log_back.astype(np.float32))
    return Model(langs, out)


def sample(
    docs: DataFrame, folds: tuple[int, ...], key: str, text: str, lang: str, max_chars: int, longest: int = LONGEST, max_langs: int = MAX_LANGS
) -> DataFrame:
    """Labelled rows (lang, text) of the folds, chosen by a hash of key and text: about max_chars characters, spread evenly over languages.

    Of a longer text a window of ``longest`` characters counts, at a place given by the hash.  Every language
    has one row at least; beyond ``max_langs`` languages, those of most text.
    """
    rows = docs.select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), fold_of(F.col(key)).alias("fold"),
        F.pmod(F.xxhash64(F.lit("langid"), F.col(key), F.col(text)), F.lit(1 << 30)).alias("hash"),
    )
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("fold").isin(*folds))
    rows = rows.withColumns({"n": F.length("text"), "u": F.col("hash") / float(1 << 30)}).where("n > 0")
    totals = rows.groupBy("lang").agg(F.sum(F.least("n", F.lit(longest))).alias("total"), F.min("u").alias("first"))
    shares = totals.orderBy(F.col("total").desc(), "lang").limit(max_langs).collect()
    if not shares:
        return rows.select("lang", "text").limit(0)
    each = max_chars / len(shares)
    rate = F.create_map(*[x for r in shares for x in (F.lit(r["lang"]), F.lit(max(r["first"], min(1.0, each / r["total"]))))])
    window = F.substring("text", F.pmod(F.col("hash"), F.greatest(F.lit(1), F.col("n") - longest + 1)).cast("int") + 1, F.lit(longest))
    return rows.where(F.col("u") <= rate[F.col("lang")]).select("lang", window.alias("text"))


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_chars: int = MAX_CHARS,
    reject: float = REJECT,
    longest: int = LONGEST,
    max_langs: int = MAX_LANGS,
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> Model | None:
    """A model learned from folds 2, 3 and 4 and calibrated on fold 1; None without labelled text.

    The sample's bounds are ``max_chars``, ``longest`` and ``max_langs``, see ``sample``.
    """
    bounds = (longest, max_langs)
    rows = sample(docs, (2, 3, 4), key, text, lang, max_chars, *bounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for name, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                by.setdefault(name, []).append(symbols(t))
        for name, parts in by.items():
            s = np.concatenate(parts)
            g = np.lib.stride_tricks.sliding_window_view(s, ORDER)
            g = g[g[:, -1] != EDGE]
            if not len(g):
                continue
            # one row of ORDER symbols as one key of 16 bytes
            flat = np.ascontiguousarray(g).view([("", np.uint32)] * ORDER).ravel()
            u, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * len(u)), "gram": pa.array([x.tobytes() for x in u], pa.binary()), "n": pa.array(n, pa.int64())}
            )

    counted = rows.mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    if not got.num_rows:
        return None
    names = got["lang"].to_numpy(zero_copy_only=False)
    grams = np.frombuffer(b"".join(got["gram"].to_pylist()), np.uint32).reshape(-1, ORDER)
    n = got["n"].to_numpy()
    langs = sorted(set(names))
    model = smooth(langs, [grams[names == k] for k in langs], [n[names == k] for k in langs])
    if model.size() > max_model_bytes and max_chars > 1:
        return fit(docs, key, text, lang, max_chars // 2, reject, longest, max_langs, max_model_bytes)
    checked = _score(sample(docs, (1,), key, text, lang, max_chars // 4, *bounds).withColumnRenamed("lang", "k"), model)
    limits = checked.where("k = lang_pred").groupBy("k").agg(F.percentile_approx("entropy", 1 - reject, 1000).alias("limit"))
    model.limits = {r["k"]: r["limit"] for r in limits.collect()}
    return model


def _score(rows: DataFrame, model: Model | None) -> DataFrame:
    """(k, lang_pred, score, entropy) of (k, text) rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most max_model_bytes, see fit
    key_type = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            n = len(texts)
            pred, score, entropy = [UND] * n, np.zeros(n), [None] * n
            if m is not None and n:
                for a, b in _runs([len(t or "") for t in texts], 4 * BATCH):
                    h = m.entropies([t or "" for t in texts[a:b]])
                    for i in np.nonzero(~np.isnan(h[:, 0]))[0]:
                        best = int(h[i].argmin())
                        pred[a + i], entropy[a + i] = m.langs[best], float(h[i, best])
                        score[a + i] = 1.0 / np.exp(np.maximum(-60.0, -8.0 * (h[i] - h[i, best]))).sum()
            yield pa.RecordBatch.from_arrays(
                [batch["k"], pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, pa.float64())],
                names=["k", "lang_pred", "score", "entropy"],
            )

    return rows.select("k", "text").mapInArrow(run, f"k {key_type}, lang_pred string, score double, entropy double")


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of every whole text: (key, held_out, lang_pred, score, entropy, accepted).

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.  ``accepted``
    is false for ``und`` and beyond the language's calibrated entropy.  Null keys count as held out;
    ties go to the first language by name; repeated rows are predicted each; an empty table gives
    no rows; other columns are ignored.
    """
    scored = _score(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), model)
    limits = model.limits if model else {}
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("lang_pred")] if limits else F.lit(None)
    return scored.select(
        F.col("k").alias(key),
        F.coalesce(fold_of(F.col("k")) == 0, F.lit(True)).alias("held_out"),
        "lang_pred",
        "score",
        "entropy",
        (F.col("entropy").isNotNull() & F.coalesce(F.col("entropy") <= limit, F.lit(True))).alias("accepted"),
    )


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
