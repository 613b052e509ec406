"""BPE encoding and decoding through a table of distinct words.

Texts are dealt into blocks and shuffled once.  Each block lists its distinct words
(pieces of the pre-tokenizer's pattern), packed by a hash part; a part encodes each of its
distinct words exactly once, whichever blocks ask for it, and sends every block the ids in
the order it asked; the block then joins ids back to the words of its texts by position.
Decoding joins ids to the vocabulary's pieces, whose number is fixed by the vocabulary.

A block holds a bounded share of the texts; a frequent word costs one entry a block, not one a
place.  Parts follow the vocabulary, which grows like the square root of a corpus, so a block's
words go to far fewer parts than there are blocks.  Blocks are dealt by key, text and input
partition, so rows that are equal in key and text do not all meet in one block.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import parallelism, table

#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.json"
#: Texts of a block, and what a task packs at a time.
BLOCK_BYTES = 8 << 20
PACKED_BYTES = 8 << 20
#: One part for so many times the square root of the corpus in bytes, and that many parts at least.
PART_ROOTS = 2048
PARTS = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def special_tokens(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.load(open(path))["added_tokens"]}


@lru_cache(maxsize=1)
def _finders():
    """Two finders of the pattern's pieces: for texts within the basic plane, and for any text.

    The first writes the letter and number classes out as ranges, which the standard matcher turns
    into bitmaps; it is more than twice as fast.
    """
    import regex

    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(kind: str) -> str:
        return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(rf"\p{{{kind}}}+", plane))

    blank = "".join(f"\\u{ord(c):04x}" for c in regex.findall(r"\s", plane))
    quick = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{ranges('L')}{ranges('N')}]")
    quick = quick.replace(r"\p{L}", f"[{ranges('L')}]").replace(r"\p{N}", f"[{ranges('N')}]")
    quick = quick.replace(r"\s", f"[{blank}]").replace(r"(?!\S)", f"(?![^{blank}])")
    return re.compile(quick).findall, regex.compile(PATTERN).findall


def _pieces_of(text: str) -> list[str]:
    quick, whole = _finders()
    # a text within the basic plane takes two bytes a character in UTF-16
    within = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
    return quick(text) if within else whole(text)


@lru_cache(maxsize=2)
def splitter(path: str):
    """A function from a text to its words; special tokens are words of their own."""
    specials = sorted(special_tokens(path), key=len, reverse=True)
    if not specials:
        return _pieces_of
    cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
    marks = set(specials)

    def words(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return _pieces_of(text)
        out: list[str] = []
        for part in cut.split(text):
            if part in marks:
                out.append(part)
            else:
                out.extend(_pieces_of(part))
        return out

    return words


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: printable Latin-1 bytes as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The vocabulary's id-to-piece table: as many entries as the vocabulary has ids."""
    spec = json.load(open(path))
    letters = byte_letters()
    ids = dict(spec["model"]["vocab"])
    out = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for piece, n in ids.items():
        out[n] = bytes(letters[c] for c in piece)
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def _part(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts


def _by_part(distinct: Iterable[str], parts: int) -> dict[int, list[str]]:
    """Distinct words by hash part, each part sorted: both sides of the join know this order."""
    by: dict[int, list[str]] = {}
    for w in distinct:
        by.setdefault(_part(w, parts), []).append(w)
    for ws in by.values():
        ws.sort()
    return by


def _pack(columns: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(columns)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _ids(rows: list[np.ndarray]) -> dict[str, pa.Array]:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
    return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))}


def encode(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    finish: Callable[[list[np.ndarray]], dict[str, pa.Array]] = _ids,
    columns: str = "ids array<int>",
) -> DataFrame:
    """The ids of every whole text: (key, ids ARRAY<INT>), one row per input row.

    ``finish`` may make other ``columns`` of the texts' ids where they are joined, so that ids
    that are only summed up need not leave the task.

    Null and empty texts have no ids; null keys and repeated rows are kept; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(parallelism(spark), -(-total // block_bytes))
    parts = min(n, max(PARTS, math.isqrt(total) // PART_ROOTS))
    body = F.coalesce(F.col(text), F.lit(""))
    block = F.pmod(F.xxhash64(F.col(key), body, F.spark_partition_id()), F.lit(n)).cast("int")
    slim = docs.select(block.alias("block"), F.col(key).alias("k"), body.alias("t"))
    key_type = slim.schema["k"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block as one compressed piece, so that texts take less room on the way."""
        held, size = [], 0

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by("block").combine_chunks()
            blocks = rows["block"].to_numpy()
            starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.empty(0, int)
            ends = np.r_[starts[1:], len(blocks)]
            texts = rows.select(["k", "t"])
            packed = [_pack(texts.slice(a, b - a)) for a, b in zip(starts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(blocks[starts], pa.int32()), pa.array(packed, pa.binary())], names=["block", "rows"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > PACKED_BYTES:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    dealt = slim.mapInArrow(deal, "block int, rows binary").repartition(n, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = splitter(path)
        seen: dict[int, set[str]] = {}
        for batch in batches:
            for b, rows in zip(batch["block"].to_pylist(), batch["rows"], strict=True):
                distinct = seen.setdefault(b, set())
                for t in _unpack(rows.as_buffer())["t"].to_pylist():
                    distinct.update(words(t))
        for b in list(seen):
            by = _by_part(seen.pop(b), parts)
            packed = [_pack(pa.table({"w": pa.array(ws, pa.string())})) for ws in by.values()]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(by, pa.int32()), "block": pa.array([b] * len(by), pa.int32()), "words": pa.array(packed, pa.binary())}
            )

    def answer(asked: pa.Table) -> pa.Table:
        lists = [_unpack(w.as_buffer())["w"].to_pylist() for w in asked["words"]]
        once = list({w for ws in lists for w in ws})
        place = {w: i for i, w in enumerate(once)}
        kind = _id_type(path)
        flat, counts = [], np.zeros(len(once), np.uint32)
        for s in range(0, len(once), 20_000):
            for i, e in enumerate(tokenizer(path).encode_batch(once[s : s + 20_000], add_special_tokens=False), s):
                ids = e.ids
                counts[i] = len(ids)
                flat += ids
        known, ends = np.array(flat, kind), np.cumsum(counts, dtype=np.int64)
        packed = []
        for ws in lists:
            at = np.fromiter((place[w] for w in ws), np.int64, len(ws))
            packed.append(_pack(pa.table({"ids": [pa.scalar(_gather(known, counts, ends, at).tobytes())], "counts": [pa.scalar(counts[at].tobytes())]})))
        return pa.table({"block": asked["block"], "part": asked["part"], "answer": pa.array(packed, pa.binary())})

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        words = splitter(path)
        number: dict[str, int] = defaultdict(count().__next__)  # words of the block as they come
        keys, found = [], []
        for packed in left["rows"]:
            rows = _unpack(packed.as_buffer())
            keys += rows["k"].chunks
            found += [np.array([number[w] for w in words(t)], np.int32) for t in rows["t"].to_pylist()]
        own = _by_part(number, parts)
        lengths, known, order = [np.empty(0, np.uint32)], [np.empty(0, _id_type(path))], []
        for p, packed in zip(right["part"].to_pylist(), right["answer"], strict=True):
            got = _unpack(packed.as_buffer())
            lengths.append(np.frombuffer(got["counts"][0].as_buffer(), np.uint32))
            known.append(np.frombuffer(got["ids"][0].as_buffer(), _id_type(path)))
            asked = own.pop(p)
            if len(asked) != len(lengths[-1]):
                raise RuntimeError("a block's words differ between two readings of its texts")
            order += [number[w] for w in asked]
        if own:
            raise RuntimeError("a block's words differ between two readings of its texts")
        at = np.empty(len(order), np.int64)
        at[np.array(order, np.int64)] = np.arange(len(order))
        flat, counts = np.concatenate(known), np.concatenate(lengths)
        stops = np.cumsum(counts, dtype=np.int64)
        ids = [_gather(flat, counts, stops, at[f]) for f in found]
        key_column = pa.chunked_array(keys, keys[0].type if keys else None) if keys else pa.array([], pa.null())
        return pa.table({"k": key_column, **finish(ids)})

    asked = dealt.mapInArrow(ask, "part int, block int, words binary")
    answered = asked.groupBy("part").applyInArrow(answer, "block int, part int, answer binary")
    placed = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(place, f"k {key_type}, {columns}")
    return placed.withColumnRenamed("k", key)


def _id_type(path: str) -> type:
    return np.uint16 if len(pieces(path)) <= 1 << 16 else np.uint32


def _gather(flat: np.ndarray, counts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen runs of ``flat``, one after the other; run i has counts[i] values and stops at ends[i]."""
    lengths = counts[chosen].astype(np.int64)
    first = ends[chosen] - lengths
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(first - before, lengths) + np.arange(lengths.sum())]


def join_pieces(ids: list[int | None], table_: list[bytes]) -> str:
    """The text that ids stand for: each id joined to its piece."""
    try:
        raw = b"".join(map(table_.__getitem__, ids))
    except (IndexError, TypeError):
        raw = b"".join(table_[i] for i in ids if i is not None and 0 <= i < len(table_))
    return raw.decode("utf-8", "replace")


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for, by a join of each id to its piece.

    Null and empty id lists give an empty text; an id outside the vocabulary stands for nothing;
    bytes that are not UTF-8 become U+FFFD.  ``ids`` and every other column stay.
    """
    path = path or vocabulary_path()

    @F.arrow_udf("string")
    def join(rows: pa.Array) -> pa.Array:
        table_ = pieces(path)
        return pa.array([join_pieces(r or [], table_) for r in rows.to_pylist()], pa.string())

    return encoded.withColumn(out, join(F.col(ids)))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every text and return digests of both.

    Returns (key, n_tokens, ids_sha256, decoded_sha256).  Defined cases as in ``encode`` and ``decode``.
    """
    path = path or vocabulary_path()

    def digest(rows: list[np.ndarray]) -> dict[str, pa.Array]:
        table_ = pieces(path)
        names = [str(i) for i in range(len(table_))]
        ids_sha, text_sha = [], []
        for row in rows:
            ids = row.tolist()
            ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(join_pieces(ids, table_).encode()).hexdigest())
        return {
            "n_tokens": pa.array(map(len, rows), pa.int64()),
            "ids_sha256": pa.array(ids_sha, pa.string()),
            "decoded_sha256": pa.array(text_sha, pa.string()),
        }

    return encode(docs, key, text, path, finish=digest, columns="n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Ids of every text and a digest of what they decode to: (key, n_tokens, ids, decoded_sha256)."""
    path = path or vocabulary_path()

    def both(rows: list[np.ndarray]) -> dict[str, pa.Array]:
        table_ = pieces(path)
        shas = [hashlib.sha256(join_pieces(row.tolist(), table_).encode()).hexdigest() for row in rows]
        return {"n_tokens": pa.array(map(len, rows), pa.int64()), **_ids(rows), "decoded_sha256": pa.array(shas, pa.string())}

    return encode(docs, key, text, path, finish=both, columns="n_tokens long, ids array<int>, decoded_sha256 string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
