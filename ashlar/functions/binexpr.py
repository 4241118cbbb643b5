"""Bytes as columns: bounds-safe slices, unsigned integers of either endianness, printable renderings.

Spark has no unsigned types: u16 and u32 are bigint, u64 is decimal(20,0). Reads past the end are null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF


def exact(content: Column, offset: Column | int, n: int | Column) -> Column:
    """``n`` bytes at a 0-based offset, or null unless all of them are there; none are always there."""
    offset, n = (F.lit(x) if isinstance(x, int) else x for x in (offset, n))
    fits = (offset >= 0) & (n >= 0) & (offset + n <= F.octet_length(content))
    return F.when(n == 0, F.lit(b"")).when(fits, F.substring(content, (offset + 1).cast("int"), n.cast("int")))


def clamped(content: Column, offset: Column | int, n: Column | int) -> Column:
    """Up to ``n`` bytes at a 0-based offset, as many as there are."""
    offset, n = (F.lit(x) if isinstance(x, int) else x for x in (offset, n))
    return F.when(offset >= F.octet_length(content), F.lit(b"")).otherwise(F.substring(content, (offset + 1).cast("int"), n.cast("int")))


def uint(content: Column, offset: Column | int, width: int, little: bool = True) -> Column:
    """Unsigned integer of 1, 2, 4 or 8 bytes. The hex digits are swapped, not the bytes: binary reverse makes a string."""
    digits = F.hex(exact(content, offset, width))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])
    return F.conv(digits, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")


def signed16(value: Column) -> Column:
    return F.when(value >= 32768, value - 65536).otherwise(value)


def negated32(x: Column) -> Column:
    return (F.lit(1 << 32) - x).bitwiseAND(F.lit(U32))


def inverted32(x: Column) -> Column:
    return F.bitwise_not(x).bitwiseAND(F.lit(U32))


def le_hex(value: Column, width: int = 4) -> Column:
    """Hex digits of an unsigned integer in little-endian byte order; ``unhex`` makes the bytes."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])


def hex32(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value.cast("bigint"))), 8, "0"))


def shown(content: Column) -> Column:
    """One character a byte, those that cannot be printed as a dot."""
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), "[^ -~]", ".")


def spaced_hex(content: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(content)), "(..)", "$1 ")


def lead_key(content: Column) -> Column:
    """``hh hh hh hh |....|`` of the first four bytes, or ``(unreadable)``."""
    four = exact(content, 0, 4)
    return F.coalesce(F.concat(spaced_hex(four), F.lit("|"), shown(four), F.lit("|")), F.lit("(unreadable)"))


def hex_dump(content: Column, most: int) -> Column:
    """Lines of 16 bytes: offset (four digits, wrapping), hex padded to 16 places, printable characters."""
    data = clamped(content, 0, most)

    def line(at: Column) -> Column:
        part = F.substring(data, at + 1, F.lit(16))
        offset = F.lpad(F.lower(F.hex(at.bitwiseAND(F.lit(0xFFFF)).cast("bigint"))), 4, "0")
        return F.concat(offset, F.lit("  "), F.rpad(spaced_hex(part), 48, " "), F.lit(" "), shown(part), F.lit("\n"))

    n = F.octet_length(data)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1, F.lit(16)), line), "")).otherwise(F.lit(""))


def leading_zeros(content: Column, offset: int = 8, most: int = 65536, block: int = 4096) -> Column:
    """Length of the run of zero bytes at ``offset``, at most ``most``.

    Counted by whole blocks: a block that the end of the content cuts counts nothing.
    """
    size = F.greatest(F.octet_length(content) - offset, F.lit(0))
    usable = size - F.pmod(size, F.lit(block))
    part = F.substring(content, F.lit(offset + 1), F.least(usable, F.lit(most)).cast("int"))
    return (F.length(F.regexp_extract(F.hex(part), "^((00)*)", 1)) / 2).cast("bigint")

