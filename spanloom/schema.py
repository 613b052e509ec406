"""Schemas of events and spans, and constants of the trace data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Event kinds.
START, END, ATTR, LOG, ERROR = 1, 2, 3, 4, 5

IDS = ("trace_id", "span_id", "ts", "seq", "event_type", "ext_span_id")
#: Fields that a later event overwrites when it has a value.
SCALARS = (
    "parent_span_id", "session_id", "tenant_id", "status", "duration_ns",
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    "external_trace_id", "external_span_id", "external_parent_span_id", "external_session_id",
    "span_name", "display_name", "agent_name", "tool_name", "model", "input_text", "output_text",
    "eval_score", "eval_label",
)
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
EXTERNAL = ("external_trace_id", "external_span_id", "external_parent_span_id", "external_session_id")
#: Attribute keys that a secondary index of the model covers; others are matched by the final filter alone.
INDEXED_ATTRS = (
    "project_id", "loop_id", "task_fingerprint", "validation_status", "run_id", "environment", "user_id", "version",
)

_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()
_TYPES = {
    "status": _INT, "event_type": _INT, "eval_score": _INT, "eval_label": _STR, "ext_span_id": _STR,
    "logs": T.ArrayType(_STR), "attrs": T.MapType(_STR, _STR),
    **dict.fromkeys((*EXTERNAL, "span_name", "display_name", "agent_name", "tool_name", "model", "input_text", "output_text"), _STR),
}

EVENT = T.StructType(
    [T.StructField(c, _TYPES.get(c, _LONG), c not in IDS) for c in (*IDS, *SCALARS, "logs", "attrs", "_arrival")]
)


def column_type(name: str) -> T.DataType:
    return _TYPES.get(name, _LONG)
