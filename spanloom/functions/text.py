"""Tokenizers: adjacent CJK pairs and lower-cased words as expressions, a dictionary tokenizer as an Arrow UDF."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, functions as F

CJK = r"\x{4E00}-\x{9FFF}"
_RUN = rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"
_WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; CJK runs as adjacent pairs, a single one alone."""
    body = F.lower(F.coalesce(text, F.lit("")))

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(F.regexp_like(run, F.lit(rf"^[{CJK}]{{2,}}$")), pairs).otherwise(F.array(run))

    mixed = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(_RUN), F.lit(0)), cut))
    return F.when(F.regexp_like(body, F.lit(f"[{CJK}]")), mixed).otherwise(F.regexp_extract_all(body, F.lit(_WORD), F.lit(0)))


def python_tokens(text: str) -> list[str]:
    """The same tokens in plain Python, for query strings and tests."""
    out: list[str] = []
    run = ""
    kind = None
    for ch in [*text.lower(), " "]:
        k = "c" if "一" <= ch <= "鿿" else "w" if ch.isalnum() else None
        if k != kind:
            if kind == "c":
                out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
            elif kind == "w":
                out.append(run)
            run, kind = "", k
        run += ch
    return out


class Dictionary:
    """Maximum-probability segmentation over a word list with frequencies; unknown characters stand alone."""

    def __init__(self, words: dict[str, int]):
        self.words = {w: n for w, n in words.items() if w and n > 0}
        self.total = math.log(sum(self.words.values()) or 1)
        self.longest = max(map(len, self.words), default=1)

    @classmethod
    def from_lines(cls, lines: Iterable[str], extra: Iterable[str] = ()) -> Dictionary:
        """Lines of ``word frequency [tag]``; extra words get a frequency above all others."""
        words: dict[str, int] = {}
        for line in lines:
            parts = line.split()
            if parts:
                words[parts[0]] = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 1
        top = max(words.values(), default=1)
        return cls(words | dict.fromkeys(extra, top))

    def cut(self, run: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            choices = []
            for j in range(i + 1, min(len(run), i + self.longest) + 1):
                n = self.words.get(run[i:j], 0)
                if n or j == i + 1:
                    choices.append((math.log(n or 1) - self.total + best[j][0], j))
            best[i] = max(choices)
        out, i = [], 0
        while i < len(run):
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def tokens(self, text: str) -> list[str]:
        out: list[str] = []
        for m in re.finditer("[一-鿿]+|[^\\W_一-鿿]+", text.lower()):
            out += self.cut(m.group()) if "一" <= m.group()[0] <= "鿿" else [m.group()]
        return out


def dictionary_tokens(dictionary: Dictionary):
    """An Arrow UDF that tokenizes with a dictionary, which rides along in the closure."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([dictionary.tokens(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return cut
