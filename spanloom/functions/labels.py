"""Text helpers of the read models."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_quotes(value: Column) -> Column:
    return F.regexp_replace(value, r'(?s)^"(.*)"$', "$1")


def attr_label(value: Column) -> Column:
    """A JSON literal as people read it: a string without quotes and escapes, anything else unchanged."""
    bare = strip_quotes(value)
    plain = F.replace(F.replace(F.replace(F.replace(bare, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\u0001"), F.lit("\\"))
    return F.when(value.rlike(r'(?s)^".*"$'), plain).otherwise(value)


def json_literal(value: Column, text: bool) -> Column:
    """A group key as a JSON literal."""
    if not text:
        return F.coalesce(value.cast("string"), F.lit("null"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(quoted, F.lit("null"))


def shorten(value: Column, limit: int = 40) -> Column:
    return F.when(F.char_length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("…"))).otherwise(value)


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    """Price of tokens at fixed rates, to three places."""
    return F.round(input_tokens * F.lit(8e-7) + output_tokens * F.lit(4e-6), 3)
