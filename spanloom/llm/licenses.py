"""License detection by ordered signature rules.

Each rule is a regex with a label, a priority and a keyword: those of ``signatures`` are written by hand.
A text is first searched for parts of keywords, then for the keywords; only rules whose keyword occurs are run.  Detections are spans;
one whose interval lies within a detection of higher priority (or within a longer one of
the same priority) is suppressed, so a named version wins over the bare family name.

Families that come in versions and variants are written once as templates and expanded, so
every rule remains a readable pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import table
from .signatures import IDENTIFIER, NAME, NOTICE, SINGLE, VERSIONED, Rule

#: Fixed values of the base rules: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

def _version(v: str) -> str:
    """A version number as people write it: 2.0, v2, version 2.0."""
    whole, _, rest = v.partition(".")
    tail = r"(?:\.0)?" if rest == "0" else re.escape("." + rest) if rest else ""
    return rf"(?:version |ver\.? |v\.? ?)?{whole}{tail}(?![\d.]*\d)"


#: Versioned families: label stem, keyword, name pattern, versions.
FAMILIES = (
    ("apache", "apache", r"apache(?: software)?(?: license)?", ("1.0", "1.1", "2.0")),
    ("gpl", "general public license", r"(?:gnu )?general public license", ("1.0", "2.0", "3.0")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public license", ("2.1", "3.0")),
    ("lgpl", "library general public", r"(?:gnu )?library general public license", ("2.0",)),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "affero general public", r"(?:gnu )?affero general public license", ("1.0", "3.0")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1.0", "3.0")),
    ("gfdl", "free documentation license", r"(?:gnu )?free documentation license", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla public license", r"mozilla public license", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", r"mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public license", r"eclipse public license", ("1.0", "2.0")),
    ("epl", "epl", r"epl", ("1.0", "2.0")),
    ("cddl", "cddl", r"cddl", ("1.0", "1.1")),
    ("eupl", "eupl", r"eupl", ("1.0", "1.1", "1.2")),
    ("artistic", "artistic license", r"artistic license", ("1.0", "2.0")),
    ("ofl", "ofl", r"ofl", ("1.0", "1.1")),
)

#: Creative Commons: variant, and how its words are spelled out.
CC_VARIANTS = {
    "by": "attribution",
    "by-sa": "attribution[- ]sharealike",
    "by-nc": "attribution[- ]noncommercial",
    "by-nd": "attribution[- ]noderiv(?:ative)?s",
    "by-nc-sa": "attribution[- ]noncommercial[- ]sharealike",
    "by-nc-nd": "attribution[- ]noncommercial[- ]noderiv(?:ative)?s",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority, then as written."""
    out = list(SINGLE)
    for stem, keyword, name, versions in FAMILIES:
        for v in versions:
            sep = r"(?:,? |-)"
            out.append(Rule(f"{stem}-{v}", VERSIONED, keyword, rf"\b{name}{sep}{_version(v)}"))
            out.append(Rule(f"{stem}-{v}", NOTICE, keyword, rf"\blicensed under (?:the )?{name}{sep}{_version(v)}"))
            if stem.endswith(("gpl", "gfdl")):
                out.append(Rule(f"{stem}-{v}-or-later", NOTICE, keyword, rf"\b{name}{sep}{_version(v)},?[ -]or[ -](?:\(at your option\) )?(?:any )?later"))
                out.append(Rule(f"{stem}-{v}-only", NOTICE, keyword, rf"\b{name}{sep}{_version(v)}[ -]only"))
    for variant, words in CC_VARIANTS.items():
        short = variant.replace("-", "[- ]")
        out.append(Rule(f"cc-{variant}", NAME, "cc", rf"\bcc[- ]{short}\b"))
        out.append(Rule(f"cc-{variant}", NAME, "creative commons", rf"\bcreative commons {words}\b"))
        for v in CC_VERSIONS:
            n = re.escape(v)
            out.append(Rule(f"cc-{variant}-{v}", VERSIONED, "cc", rf"\bcc[- ]{short}[- ]{n}(?!\.?\d)"))
            out.append(Rule(f"cc-{variant}-{v}", VERSIONED, "creative commons", rf"\bcreative commons {words}(?: international)?(?: license)? {n}(?!\.?\d)"))
            out.append(Rule(f"cc-{variant}-{v}", IDENTIFIER, "creativecommons.org", rf"creativecommons\.org/licenses/{variant}/{n}"))
    out.append(Rule("spdx", IDENTIFIER, "spdx-license-identifier", r"spdx-license-identifier: ?(?P<id>[a-z0-9.+-]+)"))
    return tuple(sorted(out, key=lambda r: -r.priority))


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int


@lru_cache(maxsize=1)
def _compiled() -> tuple[tuple[str, ...], dict[str, list[tuple[int, Rule, re.Pattern]]]]:
    by: dict[str, list] = {}
    for n, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append((n, r, re.compile(r.pattern)))
    return tuple(by), by


@lru_cache(maxsize=1)
def _gated() -> dict[str, list[str]]:
    """The keywords by the longest gate in them: most texts without a gate need no look for its keywords."""
    out: dict[str, list[str]] = {}
    for k in _compiled()[0]:
        out.setdefault(max((g for g in GATE if g in k), key=len), []).append(k)
    return out


#: White space of any length counts as one blank in a pattern.
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def detect(lowered: str) -> list[Detection]:
    """Detections that stand after suppression, by place, in a lower-cased text with single blanks."""
    by = _compiled()[1]
    found: list[tuple[Detection, int]] = []
    for k in (k for gate, keywords in _gated().items() if gate in lowered for k in keywords):
        if k in lowered:
            for n, r, pattern in by[k]:
                for m in pattern.finditer(lowered):
                    label = m["id"].rstrip(".") if r.label == "spdx" else r.label
                    if label:
                        found.append((Detection(m.start(), m.end(), label, r.priority), n))
    return suppress(found)


def suppress(found: list[tuple[Detection, int]]) -> list[Detection]:
    """Detections (with their rules' numbers) that lie within no other of higher priority, or longer, or equal and of an earlier rule.

    One sweep from left to right, longer intervals first: whatever may contain an interval comes
    before it, and of each priority only the furthest end so far matters.
    """
    furthest: dict[int, int] = {}
    kept = []
    for d, _ in sorted(found, key=lambda x: (x[0].start, -x[0].end, -x[0].priority, x[1])):
        if not any(end >= d.end for priority, end in furthest.items() if priority >= d.priority):
            kept.append(d)
        furthest[d.priority] = max(furthest.get(d.priority, 0), d.end)
    return sorted(kept)


#: Bytes that are not part of a word become blanks, A-Z become a-z, in one pass.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def base_places(words: list[bytes], base=BASE) -> list[tuple[int, str]]:
    """Where a base phrase's words stand one after the other: (first word's number, label)."""
    out = []
    for phrase, label in base:
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[-1], at + 1)
            except ValueError:
                break
            first = at - len(want) + 1
            if first >= 0 and words[first : at + 1] == want:
                out.append((first, label))
    return sorted(out)


def scan_text(text: str | None) -> dict:
    raw = (text or "").encode()
    words = raw.translate(_WORDS).split()
    lowered = raw.lower().decode()  # bytes have A-Z alone to lower
    places = base_places(words) if "license" in lowered else []
    spans = detect(_SPACE.sub(" ", lowered)) if any(k in lowered for k in GATE) else []
    base = {label for _, label in places}
    doubt = 1.0
    for d in spans:
        doubt *= 1 - min(0.99, d.priority / 60)
    score = max(1 - doubt, 0.9 if places else 0.0)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": places[0][0] if places else None,
        "last_word": places[-1][0] if places else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {d.label for d in spans})),
        "score": score,
        "detections": [{"start": d.start, "end": d.end, "label": d.label, "priority": d.priority} for d in spans],
    }


#: One of these stands in every text that any keyword stands in; parts of keywords, so white space cannot hide them.
GATE = (
    "permission", "mit", "expat", "x11", "isc", "bsd", "redistribution", "apache", "asl", "public", "gpl", "foundation",
    "license", "licence", "mpl", "epl", "cddl", "eupl", "ofl", "common", "unencumbered", "wtfpl", "cc", "rights", "confidential",
    "copyright", "spdx", "ncsa", "fuck", "mozilla", "portions", "neither", "advertising", "binary", "program", "altered", "agreement",
    "fee", "openssl", "eric", "evil", "beer", "everyone", "anyone", "document", "terms", "php", "royalty", "jpeg", "freetype", "exception",
    "autoconf", "bison", "llvm", "frameworx", "motosoto", "nasa", "suite", "ricoh", "industry", "watcom", "sleepycat", "latex", "cecill",
    "mulan", "datagrid", "jersey", "xfree86", "zend", "w3c", "vera", "cnri", "dedication", "data", "cern", "tapr", "polyform", "rail",
    "lizenz", "reproduced", "unauthorized", "shareware", "freeware", "classpath", "licen", "wxwindows", "redis", "oracle",
)

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("detections", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
            T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType()),
        ]))),
    ]
)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """License findings of every whole text: (key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    Detection spans are places in the text with white space runs taken as one blank.  Null and
    empty texts have no words and no labels; repeated rows are scanned each; an empty table
    gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField("k", slim.schema["k"].dataType), *FIELDS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(FIELDS)
        for batch in batches:
            found = [scan_text(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([f[x.name] for f in found], x.type) for x in arrow]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["k", *arrow.names])

    return slim.mapInArrow(run, schema).withColumnRenamed("k", key)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")


def license_places(spark, sf_dir: str) -> DataFrame:
    """The part of ``op5_license_scan`` that SQL can express."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: The base phrases in DuckDB, over all places of all words.
PLACES_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT r, doc_id, len(w) AS n_words, list_concat(
    list_transform(list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license'), lambda i: {'at': i - 1, 'label': 'mit'}),
    list_transform(list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license'), lambda i: {'at': i - 1, 'label': 'apache'}),
    list_transform(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'), lambda i: {'at': i - 1, 'label': 'gpl'})) AS p
  FROM d
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
  list_min(list_transform(p, lambda x: x['at'])) AS first_word, list_max(list_transform(p, lambda x: x['at'])) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x['label']))), ',') AS base_labels
FROM places
"""
