"""Span events from their JSON wire format.

Ids come as numbers, numeric text or any text; everything is read as text first, so 64-bit numbers
survive.  A batch with a bad row is refused as a whole: required fields are asserted where used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..ids import numeric_id
from ..schema import EXTERNAL

_S = T.StringType()
_NAMES = (
    "trace_id", "span_id", "ts", "seq", "event_type", "ext_span_id", "parent_span_id", "session_id", "status", "duration_ns",
    "input_tokens", "output_tokens", "cache_read_tokens", "cacheReadTokens", "cache_write_tokens", "cacheWriteTokens", "tenant_id",
    *EXTERNAL, "span_name", "display_name", "agent_name", "tool_name", "model", "input_text", "output_text",
)
#: Everything as text; attribute values keep their JSON spelling.
RAW = T.StructType([*[T.StructField(c, _S) for c in _NAMES], T.StructField("logs", T.ArrayType(_S)), T.StructField("attrs", T.VariantType())])


def _required(column: Column, name: str) -> Column:
    return F.coalesce(column, F.raise_error(F.lit(f"missing or bad field {name}")))


def _long(name: str) -> Column:
    return F.expr(f"try_cast({name} AS BIGINT)")


def attr_map(attrs: Column) -> Column:
    """Attributes with their values as JSON literals: strings keep their quotes."""
    pairs = F.map_entries(F.try_variant_get(attrs, "$", "map<string,variant>"))
    return F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["key"], F.to_json(e["value"]).alias("value"))))


def parse(batches: DataFrame, column: str = "value", tenant_id: int | None = None, strict: bool = True) -> DataFrame:
    """Events of a column of JSON arrays; ``tenant_id`` from the request context replaces any in the body.

    With ``strict`` a row without a required field fails the batch; otherwise such rows are dropped.
    """
    rows = batches.select(F.inline(F.from_json(column, T.ArrayType(RAW), {"mode": "FAILFAST" if strict else "PERMISSIVE"})))
    return convert(rows, tenant_id, strict)


def convert(rows: DataFrame, tenant_id: int | None = None, strict: bool = True) -> DataFrame:
    """Rows of the ``RAW`` schema as events."""
    check = _required if strict else (lambda c, _: c)
    trimmed = F.trim("display_name")
    ids = {
        "trace_id": check(numeric_id(F.col("trace_id")), "trace_id"),
        "span_id": check(numeric_id(F.col("span_id")), "span_id"),
        "ts": check(_long("ts"), "ts"),
        "seq": check(_long("seq"), "seq"),
        "event_type": check(_long("event_type").cast("int"), "event_type"),
        "ext_span_id": check(F.col("ext_span_id"), "ext_span_id"),
        "parent_span_id": numeric_id(F.col("parent_span_id")),
        "session_id": numeric_id(F.col("session_id")),
    }
    out = rows.select(
        *[c.alias(n) for n, c in ids.items()],
        _long("status").cast("int").alias("status"),
        *[_long(c).alias(c) for c in ("duration_ns", "input_tokens", "output_tokens")],
        F.coalesce(_long("cache_read_tokens"), _long("cacheReadTokens")).alias("cache_read_tokens"),
        F.coalesce(_long("cache_write_tokens"), _long("cacheWriteTokens")).alias("cache_write_tokens"),
        (_long("tenant_id") if tenant_id is None else F.lit(tenant_id).cast("long")).alias("tenant_id"),
        *[F.coalesce(e, e.removeprefix("external_")).alias(e) for e in EXTERNAL],
        "span_name",
        F.when(trimmed != "", trimmed).alias("display_name"),
        "agent_name", "tool_name", "model", "input_text", "output_text",
        F.coalesce("logs", F.array().cast("array<string>")).alias("logs"),
        attr_map(F.col("attrs")).alias("attrs"),
    )
    if not strict:
        out = out.where("trace_id is not null and span_id is not null and ts is not null and seq is not null and event_type is not null and ext_span_id is not null")
    return out


def read(spark: SparkSession, path: str, tenant_id: int | None = None) -> DataFrame:
    """Events of JSON files, one array or one object a line."""
    return convert(spark.read.schema(RAW).option("mode", "FAILFAST").json(path), tenant_id)
