import re

import pytest

from spanloom.llm import licenses as L

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = sorted((i, lab) for p, lab in L.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({lab for _, lab in places}))


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_base_columns(spark, which, request):
    docs = request.getfixturevalue(which)
    got = L.scan(docs).collect()
    key = lambda r: (r.doc_id or -1, str((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)))
    assert sorted(map(key, got)) == sorted((r.doc_id or -1, str(by_hand(r.text))) for r in docs.collect())
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert L.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("LICENSED UNDER CC BY-NC 4.0", "cc-by-nc-4.0"),
        ("the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("GNU Lesser General\nPublic License, version 2.1", "gpl,lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("GPL-2.0-or-later", "gpl-2.0-or-later"),
        ("GPL version 2 with the Classpath exception", "classpath-exception-2.0,gpl-2.0"),
        ("you think this stuff is worth it, you can buy me a\nbeer", "beerware"),
        ("the NetHack General Public License", "gpl,ngpl"),
        ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl"),
        ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee", "ntp"),
        ("our end user license agreement, CERN Open Hardware Licence", "cern-ohl,eula"),
        ("no part of this book may be\tREPRODUCED", "proprietary"),
        ("mit-license MIT  license", "mit"),
        ("admitted license", ""),
        ("nothing here", ""),
        ("", ""),
    ],
)
def test_labels(text, labels):
    assert L.scan_text(text)["labels"] == labels


def test_containment_and_gate():
    spans = L.detect("licensed under the apache license, version 2.0")
    assert [d.label for d in spans] == ["apache-2.0"]
    keywords, _ = L._compiled()
    assert len(L.SINGLE) > 200 and len(L.rules()) > 400
    for k in keywords:  # a text with a keyword passes the gate, whatever white space it holds
        assert any(g in part for g in L.GATE for part in [k, *k.split()]), k


def by_every_rule(text):
    """All rules without the keyword gate, and each detection against each other one."""
    lowered = re.sub(r"[\x20\x09-\x0D]+", " ", (text or "").translate(LOWER))
    found = []
    for n, r in enumerate(L.rules()):
        for m in re.finditer(r.pattern, lowered):
            label = m["id"].rstrip(".") if r.label == "spdx" else r.label
            if label:
                found.append((L.Detection(m.start(), m.end(), label, r.priority), n))

    def over(a, na, b, nb):  # a suppresses b
        if not (a.start <= b.start and b.end <= a.end):
            return False
        long = (a.end - a.start) - (b.end - b.start)
        return (a.priority, long, -na) > (b.priority, 0, -nb)

    return sorted(b for b, nb in found if not any(over(a, na, b, nb) for a, na in found))


def test_labels_against_every_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    parts = ["gpl ", "GPL-2.0-or-later ", "cc by-nc 4.0 ", "licensed under the apache license, version 2.0 ", "mit license ", "the ", "creative commons attribution 3.0 ",
             "SPDX-License-Identifier: MIT ", "spdx-license-identifier: ... ", "lgpl 2.1 only ", "bsd license "]
    import random

    rnd = random.Random(1)
    mixed = ["".join(rnd.choices(parts, k=rnd.randint(1, 25))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*(r.text for r in docs.collect()), *mixed])]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    labelled = 0
    for i, t in rows:
        want = by_every_rule(t)
        assert [tuple(d) for d in got[i].detections] == [tuple(d) for d in want], t
        base = set(filter(None, by_hand(t)[4].split(",")))
        assert got[i].labels == ",".join(sorted(base | {d.label for d in want}))
        doubt = 1.0
        for d in want:
            doubt *= 1 - min(0.99, d.priority / 60)
        assert got[i].score == pytest.approx(max(1 - doubt, 0.9 if base else 0))
        labelled += bool(want)
    assert labelled > 250


def test_many_detections_in_linear_time():
    import time

    began = time.perf_counter()
    L.scan_text("gpl " * 100_000)
    assert time.perf_counter() - began < 10


def test_an_identifier_of_dots_is_no_label():
    assert L.scan_text("SPDX-License-Identifier: ... mit license")["labels"] == "mit"
