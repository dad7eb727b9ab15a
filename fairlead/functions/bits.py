"""Little-endian bit fields of a message payload as Column expressions.

The payload travels as its hex text (two characters per byte), so one field is a few substrings and
one conv(); everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_hex(data: Column) -> Column:
    return F.hex(data)


def bits(hex_text: Column, offset: int, width: int, signed: bool) -> Column:
    """The integer in ``width`` bits from bit ``offset``; NULL when the payload is too short or the
    field holds its "not available" value (all ones, or the highest positive number if signed)."""
    first, shift = divmod(offset, 8)
    n_bytes = (shift + width + 7) // 8
    pairs = [F.substring(hex_text, 2 * (first + i) + 1, 2) for i in reversed(range(n_bytes))]
    raw = F.conv(F.concat(*pairs), 16, 10).cast("bigint")
    if shift:
        raw = F.shiftright(raw, shift)
    if width < 8 * n_bytes:
        raw = raw.bitwiseAND(F.lit((1 << width) - 1))
    missing = (1 << (width - 1)) - 1 if signed else (1 << width) - 1
    value = raw
    if signed:
        value = F.when(raw >= F.lit(1 << (width - 1)), raw - F.lit(1 << width)).otherwise(raw)
    enough = F.length(hex_text) >= 2 * (first + n_bytes)
    return F.when(enough & (raw != F.lit(missing)), value)


def little_endian(value: Column, n_bytes: int) -> Column:
    """Hex text of an integer as ``n_bytes`` little-endian bytes (the inverse of ``bits``)."""
    whole = F.when(value < 0, value + F.lit(1 << (8 * n_bytes))).otherwise(value).cast("bigint")
    return F.concat(*[F.lpad(F.hex(F.shiftright(whole, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n_bytes)])
