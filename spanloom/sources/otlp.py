"""Spans in OTLP/HTTP JSON as start and end events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..ids import numeric_id, unsigned

_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double>"
_ATTRS = f"array<struct<key: string, value: {_VALUE}>>"
SPAN = (
    "struct<traceId: string, trace_id: string, spanId: string, span_id: string, parentSpanId: string, parent_span_id: string, name: string, "
    "startTimeUnixNano: string, start_time_unix_nano: string, endTimeUnixNano: string, end_time_unix_nano: string, "
    f"status: struct<code: string>, attributes: {_ATTRS}, events: array<struct<name: string, attributes: {_ATTRS}>>>"
)
SCHEMA = (
    f"struct<resourceSpans: array<struct<scopeSpans: array<struct<spans: array<{SPAN}>>>>>, resource_spans: array<struct<scope_spans: array<struct<spans: array<{SPAN}>>>>>>"
)

#: Attribute keys of the public conventions, in order of preference.
MODEL = ("gen_ai.request.model", "gen_ai.response.model", "llm.model_name")
INPUT_TOKENS = ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt")
OUTPUT_TOKENS = ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion")
CACHE_READ = ("gen_ai.usage.cache_read.input_tokens",)
CACHE_WRITE = ("gen_ai.usage.cache_creation.input_tokens",)
AGENT = ("gen_ai.agent.name", "agent.name")
TOOL = ("gen_ai.tool.name", "tool.name")
INPUT = ("input.value", "gen_ai.prompt")
OUTPUT = ("output.value", "gen_ai.completion")
SESSION = ("session.id", "gen_ai.conversation.id", "session_id")
TENANT = ("tenant.id", "tenant_id")
BODY = ("gen_ai.prompt", "gen_ai.completion", "gen_ai.event.content", "content", "message")


def _attr(attrs: Column, key: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["key"] == key), F.lit(0))["value"]


def _number(value: Column) -> Column:
    return F.coalesce(unsigned(value["intValue"]), F.floor(value["doubleValue"]).cast("long"))


def first_text(attrs: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[_attr(attrs, k)["stringValue"] for k in keys], F.lit(None).cast("string"))


def first_number(attrs: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[_number(_attr(attrs, k)) for k in keys], F.lit(None).cast("long"))


def first_numeric(attrs: Column, keys: Sequence[str]) -> Column:
    """Numbers, and texts that are numbers."""
    values = [_attr(attrs, k) for k in keys]
    return F.coalesce(*[F.coalesce(_number(v), unsigned(v["stringValue"])) for v in values])


def first_session(attrs: Column, keys: Sequence[str]) -> Column:
    """Numbers as they are, any other text by its hash."""
    values = [_attr(attrs, k) for k in keys]
    return F.coalesce(*[F.coalesce(_number(v), numeric_id(v["stringValue"])) for v in values])


def low_id(hexadecimal: Column) -> Column:
    """The low 64 bits of a hexadecimal id, 0 where it is none."""
    tail = F.lower(F.substring(F.trim(hexadecimal), -16, 16))
    whole = F.when(tail.rlike("^[0-9a-f]{1,16}$"), F.lpad(tail, 16, "0"))
    high = F.conv(F.substring(whole, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(whole, 9, 8), 16, 10).cast("long")
    return F.coalesce(F.shiftleft(high, 32).bitwiseOR(low), F.lit(0).cast("long"))


def flatten_messages(text: Column) -> Column:
    """The contents of a JSON list of messages, a line each; any other text as it is."""
    looks = F.ltrim(text).rlike(r"^[\[{]")
    plain = F.coalesce(
        F.from_json(text, "array<struct<content: string>>"), F.array(F.from_json(text, "struct<content: string>")), F.array().cast("array<struct<content: string>>")
    )

    def contents(m: Column) -> Column:
        parts = F.from_json(m["content"], "array<struct<text: string>>")
        texts = F.array_compact(F.transform(F.coalesce(parts, F.array().cast("array<struct<text: string>>")), lambda p: p["text"]))
        return F.when(m["content"].rlike(r"^\s*\[") & (F.size(texts) > 0), texts).when(m["content"].isNotNull(), F.array(m["content"])).otherwise(F.array().cast("array<string>"))

    found = F.flatten(F.transform(F.filter(plain, lambda m: m.isNotNull()), contents))
    return F.when(looks & (F.size(found) > 0), F.array_join(found, "\n")).otherwise(text)


def _event_text(events: Column, marks: Sequence[str], unless: Sequence[str] = ()) -> Column:
    name = lambda e: F.lower(F.coalesce(e["name"], F.lit("")))

    def has(e: Column, words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | name(e).contains(w)
        return out

    own = F.filter(F.coalesce(events, F.array().cast(f"array<struct<name: string, attributes: {_ATTRS}>>")), lambda e: has(e, marks) & ~has(e, unless))
    texts = F.array_compact(F.transform(own, lambda e: flatten_messages(first_text(e["attributes"], BODY))))
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def parse(payloads: DataFrame, column: str = "value", tenant_id: int | None = None, vendor: str | None = None) -> DataFrame:
    """Two events a span, start (seq 1) and end (seq 2); resource, scope and unknown attributes are dropped.

    ``vendor`` is a prefix whose display name, session and tenant attributes are read first.
    """
    own = lambda keys, name: ((f"{vendor}.{name}", *keys) if vendor else keys)
    body = payloads.select(F.from_json(column, SCHEMA).alias("b"))
    none = F.array().cast(f"array<{SPAN}>")
    camel = F.flatten(F.transform("b.resourceSpans", lambda r: F.flatten(F.transform(r["scopeSpans"], lambda s: F.coalesce(s["spans"], none)))))
    snake = F.flatten(F.transform("b.resource_spans", lambda r: F.flatten(F.transform(r["scope_spans"], lambda s: F.coalesce(s["spans"], none)))))
    sp = body.select(F.explode(F.coalesce(camel, snake)).alias("s"))
    a = F.col("s.attributes")
    start = F.coalesce(F.expr("try_cast(coalesce(s.startTimeUnixNano, s.start_time_unix_nano) AS BIGINT)"), F.lit(0).cast("long"))
    end = F.coalesce(F.expr("try_cast(coalesce(s.endTimeUnixNano, s.end_time_unix_nano) AS BIGINT)"), F.col("t0"))
    display = F.trim(first_text(a, own((), "display_name"))) if vendor else F.lit(None).cast("string")
    code = F.col("s.status.code")
    wide = sp.withColumn("t0", start).select(
        F.coalesce("s.traceId", "s.trace_id").alias("tid"), F.coalesce("s.spanId", "s.span_id").alias("sid"),
        F.nullif(F.coalesce("s.parentSpanId", "s.parent_span_id"), F.lit("")).alias("pid"),
        "t0", end.alias("t1"),
        F.when(code == "2", 1).when(code == "1", 0).alias("status"),
        F.nullif(F.trim("s.name"), F.lit("")).alias("span_name"), F.nullif(display, F.lit("")).alias("display_name"),
        first_text(a, MODEL).alias("model"), first_text(a, AGENT).alias("agent_name"), first_text(a, TOOL).alias("tool_name"),
        first_number(a, INPUT_TOKENS).alias("input_tokens"), first_number(a, OUTPUT_TOKENS).alias("output_tokens"),
        first_number(a, CACHE_READ).alias("cache_read_tokens"), first_number(a, CACHE_WRITE).alias("cache_write_tokens"),
        F.coalesce(flatten_messages(first_text(a, INPUT)), _event_text(F.col("s.events"), ("prompt", "user", "system", "message"), ("completion", "assistant", "choice"))).alias("input_text"),
        F.coalesce(flatten_messages(first_text(a, OUTPUT)), _event_text(F.col("s.events"), ("completion", "assistant", "choice"))).alias("output_text"),
        first_session(a, own(SESSION, "session_id")).alias("session_id"), first_text(a, own(SESSION, "session_id")).alias("external_session_id"),
        (first_numeric(a, own(TENANT, "tenant_id")) if tenant_id is None else F.lit(tenant_id).cast("long")).alias("tenant_id"),
    )
    described = ("span_name", "display_name", "model", "agent_name", "tool_name", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "input_text", "output_text", "session_id", "external_session_id", "tenant_id")
    sides = F.array(F.lit(1), F.lit(2))
    ev = wide.select("*", F.explode(sides).alias("n"))
    begins = F.col("n") == 1
    return ev.select(
        low_id(F.col("tid")).alias("trace_id"), low_id(F.col("sid")).alias("span_id"), F.when(begins, F.col("t0")).otherwise(F.col("t1")).alias("ts"),
        F.col("n").cast("long").alias("seq"), F.col("n").alias("event_type"), F.col("sid").alias("ext_span_id"),
        F.when(F.col("pid").isNotNull(), low_id(F.col("pid"))).alias("parent_span_id"),
        F.when(~begins, F.col("status")).alias("status"),
        F.when(~begins, F.greatest(F.col("t1") - F.col("t0"), F.lit(0).cast("long"))).alias("duration_ns"),
        *[F.when(begins, F.col(c)).alias(c) for c in described],
        F.col("tid").alias("external_trace_id"), F.col("sid").alias("external_span_id"), F.col("pid").alias("external_parent_span_id"),
    )
