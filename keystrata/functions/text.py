"""Small scalar functions of the inspection tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_text(nanos: Column) -> Column:
    """1000 ms and more in seconds, under 0.01 ms in microseconds, else milliseconds; two decimals."""
    ms = nanos / F.lit(1e6)
    return F.when(ms >= 1000, F.format_string("%.2f s", nanos / F.lit(1e9))).when(ms < 0.01, F.format_string("%.2f us", nanos / F.lit(1e3))).otherwise(F.format_string("%.2f ms", ms))


def little_endian_u32(n: Column) -> Column:
    """Four bytes of an unsigned 32-bit number, least significant first.

    reverse() works on characters, so the bytes are taken one by one.
    """
    hexed = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(hexed, i, 2) for i in (7, 5, 3, 1)]))


def encode_entry(op: Column, seq: Column, key: Column, value: Column) -> Column:
    """The binary form of an entry: type, sequence number, key and value lengths, key, value."""
    k, v = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(F.unhex(F.lpad(F.hex(op.cast("long")), 2, "0")), little_endian_u32(seq), little_endian_u32(F.octet_length(k)), little_endian_u32(F.octet_length(v)), k, v)
