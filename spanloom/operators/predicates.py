"""Filters of the query surface as Column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import attr_label, strip_quotes
from ..schema import INDEXED_ATTRS


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def overlaps(time_from: int | None, time_to: int | None) -> list[Column]:
    """A span matches a closed window when its events' span of time meets it."""
    out = []
    if time_from is not None:
        out.append(F.col("max_ts") >= time_from)
    if time_to is not None:
        out.append(F.col("min_ts") <= time_to)
    return out


@dataclass
class SearchFilter:
    """A conjunction over folded spans; fields left None do not filter. Ids given as text match the external id."""

    trace_id: int | None = None
    external_trace_id: str | None = None
    session_id: int | None = None
    span_id: int | None = None
    agent_name: str | None = None
    tool_name: str | None = None
    model: str | None = None
    status: int | None = None
    time_from: int | None = None
    time_to: int | None = None
    tenant_id: int | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    text: str | None = None

    def column(self) -> Column:
        parts = overlaps(self.time_from, self.time_to)
        for name in ("trace_id", "external_trace_id", "session_id", "span_id", "agent_name", "tool_name", "model", "status", "tenant_id"):
            if (v := getattr(self, name)) is not None:
                parts.append(F.col(name) == v)
        parts += [F.col("attrs")[k] == v for k, v in self.attrs.items()]
        if self.text:
            parts.append(contains_text(self.text))
        return all_of(parts)

    def unsupported_attrs(self) -> list[str]:
        """Attribute keys that no index covers; they are filtered all the same."""
        return sorted(set(self.attrs) - set(INDEXED_ATTRS))


def contains_text(text: str) -> Column:
    """Substring match over input, output and every log."""
    hits = [F.coalesce(F.col(c).contains(text), F.lit(False)) for c in ("input_text", "output_text")]
    logs = F.coalesce(F.exists("logs", lambda x: x.contains(text)), F.lit(False))
    return hits[0] | hits[1] | logs


def attr_matches(key: str, value: str) -> Column:
    """Equal as literals, or after quotes and escapes are removed."""
    own = F.col("attrs")[key]
    return F.coalesce((own == value) | (attr_label(own) == attr_label(F.lit(value))), F.lit(False))


def metadata_attr_matches(column: Column, value: str) -> Column:
    """Equal after outer quotes are removed."""
    return F.coalesce(strip_quotes(column) == re.sub(r'^"(.*)"$', r"\1", value), F.lit(False))


#: Spellings of request fields.
ALIASES = {
    "traceId": "external_trace_id", "trace_id": "external_trace_id", "sessionId": "session_id", "session_id": "session_id",
    "spanId": "span_id", "span_id": "span_id", "agent": "agent_name", "agentName": "agent_name", "agent_name": "agent_name",
    "tool": "tool_name", "toolName": "tool_name", "tool_name": "tool_name", "model": "model", "status": "status",
    "timeFrom": "time_from", "time_from": "time_from", "timeTo": "time_to", "time_to": "time_to",
    "tenantId": "tenant_id", "tenant_id": "tenant_id", "text": "text", "query": "text",
}


def from_request(request: dict, tenant_id: int | None = None) -> SearchFilter:
    """A filter from a request body; the context's tenant overrides the body's."""
    out = SearchFilter(attrs={k: v if isinstance(v, str) else str(v) for k, v in (request.get("attrs") or {}).items()})
    for k, v in request.items():
        if k in ALIASES and v is not None:
            name = ALIASES[k]
            setattr(out, name, str(v) if name in ("external_trace_id", "text") else v)
    if tenant_id is not None:
        out.tenant_id = tenant_id
    return out


def truth(value: str | bool | None) -> bool:
    return value is True or str(value).strip().lower() in ("1", "true", "yes", "on")


def page_size(limit: int | None = None) -> int:
    """Limits are held to 1..500, 50 by default."""
    return 50 if limit is None else max(1, min(500, limit))


def page(df: DataFrame, order: list[Column], cursor: int = 0, limit: int | None = None) -> DataFrame:
    """A page in the given order."""
    return df.orderBy(*order).offset(max(0, cursor)).limit(page_size(limit))
