"""Bit-level scalar functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Julian day of 1970-01-01 (fixed value).
UNIX_EPOCH_JULIAN_DAY = 2_440_588
NANOS_PER_DAY = 86_400_000_000_000


def zigzag(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("long"))))


def bit_width(n: Column) -> Column:
    """Bits that hold a number from 0 to n."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n.cast("long")))).cast("int")


def uleb128_length(n: Column) -> Column:
    """Bytes of n as an unsigned LEB128 number."""
    return F.greatest(F.lit(1), F.ceil(bit_width(n) / 7)).cast("int")


def little_endian_hex(n: Column, size: int) -> Column:
    """The bytes of a whole number, least first, in hex digits."""
    digits = F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * size))
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def from_little_endian_hex(digits: Column, size: int) -> Column:
    """The signed number of little_endian_hex's digits."""
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    bits = 8 * size
    high = F.conv(F.substring(swapped, 1, size), 16, 10).cast("long")
    low = F.conv(F.substring(swapped, size + 1, size), 16, 10).cast("long")
    signed = F.when(high >= 2 ** (bits // 2 - 1), high - 2 ** (bits // 2)).otherwise(high)
    return F.shiftleft(signed, bits // 2) + low


def int96_to_nanos(day: Column, nanos: Column) -> Column:
    """Nanoseconds since 1970 of a Julian day and the nanoseconds of that day."""
    return (day.cast("long") - UNIX_EPOCH_JULIAN_DAY) * NANOS_PER_DAY + nanos.cast("long")


def decimal_precision(size: Column) -> Column:
    """Decimal digits that a signed number of so many bytes always holds."""
    return F.floor((8 * size - 1) * F.log10(F.lit(2.0))).cast("int")


def rle_header(n: Column) -> Column:
    """Header of one bit-packed run of n values: groups of eight, with the low bit set."""
    return F.shiftleft(F.ceil(n / 8).cast("long"), 1).bitwiseOR(F.lit(1).cast("long"))
