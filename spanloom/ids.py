"""Identity: text ids to numbers, and event ids.

FNV-1a over 64 bits needs wrap-around products, which ANSI arithmetic refuses; the state is kept
as two 32-bit halves, so every product fits a BIGINT.  Results are the unsigned hash's bits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of 64-bit FNV-1a.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = 0xFFFFFFFF


def fnv1a64(data: Column) -> Column:
    """64-bit FNV-1a of a BINARY column, as the BIGINT of the same bits; null of null."""
    digits = F.hex(data)
    count = F.octet_length(data)
    octets = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"),
    )

    def step(state: Column, octet: Column) -> Column:
        # the prime is 2**40 + 435: 435 goes to both halves, 2**40 moves the low half up by 8 bits
        low = state["lo"].bitwiseXOR(octet)
        product = low * (PRIME & MASK)
        high = state["hi"] * (PRIME & MASK) + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), product.bitwiseAND(F.lit(MASK)).alias("lo"))

    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET & MASK).cast("long").alias("lo"))
    return F.when(data.isNotNull(), F.aggregate(octets, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"])))


def unsigned(text: Column) -> Column:
    """A text of digits as an unsigned 64-bit number, in the BIGINT of the same bits; null for any other text and beyond 64 bits."""
    digits = F.regexp_extract(text, r"^\+?0*(\d{1,20})$", 1)
    value = F.when(digits != "", digits).cast("decimal(20,0)")
    high = value > F.lit(str((1 << 63) - 1)).cast("decimal(20,0)")
    wrapped = (value - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")
    plain = F.when(text.rlike(r"^\d{1,18}$"), text.cast("long"))  # most ids; no decimals are needed
    return F.coalesce(
        plain,
        F.when(value > F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"), F.lit(None).cast("long"))
        .when(high, F.when(wrapped < F.lit(str(1 << 63)).cast("decimal(20,0)"), wrapped).cast("long").bitwiseXOR(F.lit(-(1 << 63))))
        .otherwise(F.when(~high, value).cast("long")),
    )


def numeric_id(text: Column) -> Column:
    """A number or numeric text of 64 bits as it is, any other text by its hash."""
    return F.coalesce(unsigned(text), fnv1a64(text.cast("binary")))


def little_endian(value: Column) -> Column:
    """The eight octets of a BIGINT, least significant first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.substring(digits, i * 2 + 1, F.lit(2))), ""))


def event_id(ext_span_id: Column, seq: Column, event_type: Column) -> Column:
    """Identity of an event: the hash of its span's external id, its sequence number and its kind."""
    tag = F.unhex(F.lpad(F.hex(event_type.cast("long")), 2, "0"))
    return fnv1a64(F.concat(ext_span_id.cast("binary"), little_endian(seq), tag))


def unsigned_order(value: Column) -> Column:
    """Sorts BIGINT bit patterns as unsigned numbers."""
    return value.bitwiseXOR(F.lit(-(1 << 63)))
