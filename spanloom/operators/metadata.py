"""Annotations and dataset associations: append-only versions, the latest of which counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .fold import last_wins
from .predicates import all_of, metadata_attr_matches

STATUSES = ("active", "resolved", "rejected", "deleted")


def parse_status(text: str) -> str:
    found = text.strip().lower()
    aliases = {"open": "active", "done": "resolved", "closed": "resolved", "removed": "deleted"}
    found = aliases.get(found, found)
    if found not in STATUSES:
        raise ValueError(f"unknown status {text}")
    return found


def parse_target(text: str | None, has_span: bool) -> str:
    if not text:
        return "span" if has_span else "trace"
    found = text.strip().lower()
    if found not in ("trace", "span"):
        raise ValueError(f"unknown target {text}")
    return found


def latest(versions: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The last version of each row."""
    fields = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*fields), version).alias("v")).select(key, "v.*")


def merge_attrs(old: Column, new: Column, replace: bool = False) -> Column:
    """Attributes after an update: merged, new values winning, or replaced."""
    if replace:
        return new
    none = F.array().cast("array<struct<key:string,value:string>>")
    return last_wins(F.concat(F.coalesce(F.map_entries(old), none), F.coalesce(F.map_entries(new), none)))


def update(current: DataFrame, changes: DataFrame, fields: tuple[str, ...], tenant_id: int | None = None, replace_attrs: bool = False) -> DataFrame:
    """Next versions of the rows that ``changes`` names: (id, <field>, set_<field>).

    A field takes its new value, null included, where its ``set_`` flag is true; rows of another tenant stay.
    """
    c = changes.select("id", *[F.col(f).alias(f"n_{f}") for f in fields], *[f"set_{f}" for f in fields])
    own = current if tenant_id is None else current.where(F.col("tenant_id") == tenant_id)
    both = own.join(c, "id")
    for f in fields:
        new = merge_attrs(F.col(f), F.col("n_attrs"), replace_attrs) if f == "attrs" else F.col(f"n_{f}")
        both = both.withColumn(f, F.when(F.col(f"set_{f}"), new).otherwise(F.col(f)))
    return both.withColumn("version", F.col("version") + 1).select(*current.columns)


def soft_delete(current: DataFrame, ids: DataFrame, tenant_id: int | None = None) -> DataFrame:
    own = current if tenant_id is None else current.where(F.col("tenant_id") == tenant_id)
    return own.join(ids.select("id").distinct(), "id", "left_semi").withColumns(
        {"status": F.lit("deleted"), "version": F.col("version") + 1}
    ).select(*current.columns)


def annotation_filter(include_deleted: bool = False, attrs: dict[str, str] | None = None, **equals) -> Column:
    """Tenant, target, trace, span, label, source and status by equality; deleted ones only on request."""
    parts = [F.col(k) == v for k, v in equals.items() if v is not None]
    if not include_deleted and equals.get("status") != "deleted":
        parts.append(F.col("status") != "deleted")
    parts += [metadata_attr_matches(F.col("attrs")[k], v) for k, v in (attrs or {}).items()]
    return all_of(parts)


def association_filter(attrs: dict[str, str] | None = None, **equals) -> Column:
    return all_of([F.col(k) == v for k, v in equals.items() if v is not None] + [metadata_attr_matches(F.col("attrs")[k], v) for k, v in (attrs or {}).items()])


def newest(df: DataFrame) -> list[Column]:
    """Page order of metadata."""
    return [F.col("created_at").desc(), F.col("id").desc()]
