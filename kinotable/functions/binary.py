"""Big-endian fields of binary columns, as native expressions. Positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def piece(data: Column | str, at: Column | int, size: Column | int) -> Column:
    """Bytes [at, at + size) of a binary."""
    return F.substring(_col(data), (_lit(at) + 1).cast("int"), _lit(size).cast("int"))


def unsigned(data: Column | str, at: Column | int, size: int) -> Column:
    """Unsigned integer of 1 to 7 bytes; null behind the end of the data."""
    raw = piece(data, at, size)
    return F.when(F.octet_length(raw) == size, F.conv(F.hex(raw), 16, 10).cast("bigint"))


def unsigned64(data: Column | str, at: Column | int) -> Column:
    """Unsigned 64-bit integer as a decimal."""
    raw = piece(data, at, 8)
    return F.when(F.octet_length(raw) == 8, F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)"))


def signed32(data: Column | str, at: Column | int) -> Column:
    value = unsigned(data, at, 4)
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def version(box: Column | str) -> Column:
    return unsigned(box, 0, 1)


def flags(box: Column | str) -> Column:
    """The 24 flag bits behind a full box's version."""
    return unsigned(box, 1, 3)


def fourcc(data: Column | str, at: Column | int) -> Column:
    """Four ASCII characters; other bytes become replacement characters, which no type has."""
    return F.decode(piece(data, at, 4), "US-ASCII")


def to_bytes(value: Column | str, size: int) -> Column:
    """A whole number from 0 as `size` big-endian bytes; negative ones in two's complement of that size."""
    return F.unhex(F.right(F.lpad(F.hex(_col(value).cast("bigint")), 16, "0"), F.lit(2 * size)))


def box(kind: str, payload: Column | str) -> Column:
    """A box of a four-character type around a payload of less than 4 GiB."""
    return F.concat(to_bytes(F.octet_length(_col(payload)) + 8, 4), F.encode(F.lit(kind), "US-ASCII"), _col(payload))


def fits(offset: Column | str, size: Column | str, end: Column | str) -> Column:
    """Whether [offset, offset + size) lies within [0, end), without overflow."""
    return (_col(offset) >= 0) & (_col(size) >= 0) & (_col(offset) <= _col(end) - _col(size))
