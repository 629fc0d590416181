"""Fields of binary columns as column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest integer that a double holds exactly with all smaller ones.
SAFE_INTEGER = (1 << 53) - 1


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(b: Column | str, offset: Column | int, length: Column | int) -> Column:
    """Bytes [offset, offset + length), counted from 0."""
    place = F.lit(offset) if isinstance(offset, int) else offset
    size = F.lit(length) if isinstance(length, int) else length
    return F.substring(column(b), place.cast("int") + 1, size.cast("int"))


def be_uint(b: Column | str, offset: Column | int, length: int) -> Column:
    """An unsigned big-endian integer of up to 7 bytes; null where the bytes end early."""
    part = cut(b, offset, length)
    return F.when(F.octet_length(part) == length, F.conv(F.hex(part), 16, 10).cast("long"))


def be_u64(b: Column | str, offset: Column | int) -> Column:
    part = cut(b, offset, 8)
    return F.when(F.octet_length(part) == 8, F.conv(F.hex(part), 16, 10).cast("decimal(20,0)"))


def be_i64(b: Column | str, offset: Column | int) -> Column:
    """A signed big-endian integer of 8 bytes, from its halves."""
    high, low = be_uint(b, offset, 4), be_uint(b, (F.lit(offset) if isinstance(offset, int) else offset) + 4, 4)
    return F.shiftleft(high, 32).bitwiseOR(low)


def le_uint(b: Column | str, offset: Column | int, length: int) -> Column:
    """An unsigned little-endian integer of up to 4 bytes."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    total = be_uint(b, at, 1)
    for k in range(1, length):
        total = total + F.shiftleft(be_uint(b, at + k, 1), 8 * k)
    return total


def be_bytes(value: Column, length: int) -> Column:
    """The low ``length`` bytes of a long, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * length)))


def hex_lower(b: Column | str) -> Column:
    return F.lower(F.hex(column(b)))


def signed_byte(v: Column | str) -> Column:
    return F.when(column(v) > 127, column(v) - 256).otherwise(column(v)).cast("int")


def safe_integer(v: Column | str) -> Column:
    """The value as a long, null beyond the safe range."""
    return F.when(column(v) <= SAFE_INTEGER, column(v)).cast("long")


def utf16be(b: Column | str) -> Column:
    """Text of two-byte units without its NULs."""
    return F.replace(F.decode(column(b), "UTF-16BE"), F.char(F.lit(0)), F.lit(""))


def bits(value: Column | str, width: int, first: Column | int, count: int) -> Column:
    """``count`` bits from bit ``first`` (0: the highest) of an unsigned number of ``width`` bits, up to 63; null where they end early."""
    at = F.lit(first) if isinstance(first, int) else first
    shifted = F.call_function("shiftrightunsigned", column(value), (F.lit(width - count) - at).cast("int"))
    return F.when(at + count <= width, shifted.bitwiseAND(F.lit((1 << count) - 1)))


def range_ok(offset: Column | str, length: Column | str, size: Column | str) -> Column:
    """Whether [offset, offset + length) lies inside ``size`` bytes."""
    o, n = column(offset), column(length)
    return (o >= 0) & (n >= 0) & (o + n <= column(size)) & (o <= SAFE_INTEGER) & (n <= SAFE_INTEGER)


def matches_prefix(b: Column | str, prefix: str) -> Column:
    return F.startswith(hex_lower(b), F.lit(prefix))
