import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom import ids
from spanloom.sources import otlp, wire

from .helpers import one


def fnv(data: bytes) -> int:
    h = ids.OFFSET
    for b in data:
        h = ((h ^ b) * ids.PRIME) & ((1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def test_hash(spark):
    rnd = random.Random(6)
    texts = ["", *("".join(chr(rnd.choice((rnd.randint(32, 126), rnd.randint(0x400, 0x4FF), 0x1F600))) for _ in range(n)) for n in (1, 7, 30, 200))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.h for r in df.select(ids.fnv1a64(F.col("t").cast("binary")).alias("h")).collect()] == [fnv(t.encode()) for t in texts]


def test_event_id(spark):
    rnd = random.Random(1)
    rows = [(f"s{rnd.randint(0, 99)}", rnd.randint(0, 1 << 40), rnd.randint(1, 200)) for _ in range(20)]
    got = spark.createDataFrame(rows, "e string, s long, t int").select(ids.event_id(F.col("e"), F.col("s"), F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [fnv(e.encode() + s.to_bytes(8, "little") + bytes([t])) for e, s, t in rows]


def _batch(spark, rows):
    return spark.createDataFrame([(json.dumps(rows),)], "value string")


def test_ids_of_64_bits(spark):
    rnd = random.Random(12)
    numbers = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, *(rnd.getrandbits(rnd.randint(1, 64)) for _ in range(40))]
    others = ["", str(1 << 64), "9" * 20, "9" * 30, "-1", "1.0", "1e3", " 7", "x7"]
    rows = [(str(n), n - (1 << 64) if n >> 63 else n) for n in numbers] + [(f"000{n}", n) for n in (5, 77)] + [(t, fnv(t.encode())) for t in others]
    df = spark.createDataFrame(rows, "t string, want long")
    assert [(r.t, r.id) for r in df.select("t", ids.numeric_id(F.col("t")).alias("id")).collect()] == rows
    assert {r.n for r in df.where(F.col("t").isin(*others)).select(ids.unsigned(F.col("t")).alias("n")).collect()} == {None}


WIRE = {"trace_id": "order 66/b", "span_id": 7, "ts": "5", "seq": 1, "event_type": 1, "ext_span_id": "e", "display_name": "  ", "cacheReadTokens": 3, "tenant_id": 4, "attrs": {"s": "blue", "n": 7.5, "o": {"deep": [1, None]}}, "logs": ["a"]}


def test_wire_fields(spark):
    r = one(wire.parse(_batch(spark, [WIRE]), tenant_id=9))
    assert (r.trace_id, r.span_id, r.ts, r.external_trace_id, r.external_span_id) == (fnv(b"order 66/b"), 7, 5, "order 66/b", "7")
    assert (r.display_name, r.cache_read_tokens, r.tenant_id, r.logs, r.parent_span_id, r.session_id) == (None, 3, 9, ["a"], None, None)
    assert r.attrs == {"s": '"blue"', "n": "7.5", "o": '{"deep":[1,null]}'}


def test_a_bad_row_refuses_its_batch(spark):
    bad = {k: v for k, v in WIRE.items() if k != "seq"}
    with pytest.raises(Exception, match="seq"):
        wire.parse(_batch(spark, [WIRE, bad])).collect()
    assert wire.parse(_batch(spark, [WIRE, bad]), strict=False).count() == 1


def test_otlp_spans(spark):
    """Spans with drawn numbers, each a body of its own."""
    rnd = random.Random(31)
    attr = lambda k, **v: {"key": k, "value": v}
    want, bodies = {}, []
    for n in range(12):
        trace, span, began, took = rnd.getrandbits(128), rnd.getrandbits(64), rnd.getrandbits(40), rnd.getrandbits(30)
        tokens, code = [rnd.randint(0, 9999), rnd.randint(0, 9999)], rnd.choice((0, 1, 2))
        talk = [{"role": "user", "content": f"part {n}"}, {"role": "user", "content": [{"type": "text", "text": "and more"}]}]
        attrs = [
            attr("llm.model_name", stringValue=f"model {n % 4}"), attr("gen_ai.usage.prompt_tokens", intValue=str(tokens[0])), attr("llm.token_count.completion", intValue=tokens[1]),
            attr("shop.display_name", stringValue=f" Step {n}  "), attr("gen_ai.conversation.id", stringValue=f"talk/{n}"), attr("tenant.id", stringValue=str((1 << 64) - 1 - n)),
            attr("gen_ai.prompt", stringValue=json.dumps(talk)),
        ]
        said = [{"name": "gen_ai.choice", "attributes": [attr("content", stringValue=f"answer {n}")]}]
        one_span = {"traceId": f"{trace:032x}", "spanId": f"{span:016x}", "parentSpanId": "", "name": "step", "startTimeUnixNano": str(began), "endTimeUnixNano": str(began + took), "status": {"code": code}, "attributes": attrs, "events": said}
        bodies.append((json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [one_span]}]}]}),))
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        want[signed(span)] = (signed(trace & ((1 << 64) - 1)), f"model {n % 4}", *tokens, f"Step {n}", f"part {n}\nand more", f"answer {n}", fnv(f"talk/{n}".encode()), -1 - n, took, {0: None, 1: 0, 2: 1}[code])
    got = otlp.parse(spark.createDataFrame(bodies, "value string"), vendor="shop").collect()
    ends = {r.span_id: r for r in got if r.seq == 2}
    starts = {r.span_id: r for r in got if r.seq == 1}
    assert {
        k: (r.trace_id, r.model, r.input_tokens, r.output_tokens, r.display_name, r.input_text, r.output_text, r.session_id, r.tenant_id, ends[k].duration_ns, ends[k].status)
        for k, r in starts.items()
    } == want
    assert all(r.status is None and r.parent_span_id is None for r in starts.values())


def test_flat_text_stays(spark):
    df = spark.createDataFrame([("plain",), ("[not json",), ('{"role":"user","content":"x"}',)], "t string")
    assert [r.f for r in df.select(otlp.flatten_messages(F.col("t")).alias("f")).collect()] == ["plain", "[not json", "x"]
