"""Vector distances as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


def wide(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit(a: Column) -> Column:
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x)))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2; cosine, as the l2 distance of unit vectors; or ip, the negated inner product."""
    if metric == "l2":
        return l2(a, b)
    if metric == "cosine":
        return l2(unit(a), unit(b))
    if metric == "ip":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric}")
