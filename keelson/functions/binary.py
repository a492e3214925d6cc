"""Byte-string and counter functions on value columns (BINARY, or STRING where noted)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_len(value: Column) -> Column:
    return F.octet_length(value)


def get_byte(value: Column, offset: int) -> Column:
    """The byte at a 0-based offset; past the end a zero byte."""
    return F.when(F.octet_length(value) > offset, F.substring(value.cast("binary"), offset + 1, 1)).otherwise(F.unhex(F.lit("00")))


def set_byte(value: Column, offset: int, byte: int) -> Column:
    """The value with one byte replaced, padded with zero bytes to reach the offset."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    padded = F.when(F.octet_length(raw) > offset, raw).otherwise(F.rpad(raw, offset + 1, F.unhex(F.lit("00"))))
    return F.concat(F.substring(padded, 1, offset), F.unhex(F.lit(f"{byte:02X}")), F.substring(padded, offset + 2, 2**31 - 1 - offset - 2))


def append(value: Column, suffix: Column) -> Column:
    return F.concat(F.coalesce(value, F.lit("")), suffix)


def get_range(value: Column, start: int, end: int) -> Column:
    """Bytes start to end, 0-based and inclusive; null if start is past the end."""
    return F.when(F.octet_length(value) > start, F.substring(value, start + 1, end - start + 1))


def integer_text(value: Column) -> Column:
    """The integer of a decimal text as DECIMAL(38,0), or null."""
    return F.when(value.rlike(r"^[+-]?[0-9]{1,38}$"), value.try_cast("decimal(38,0)"))


def add_text(value: Column, n: Column) -> Column:
    """A decimal text plus n, as text; null where the text is no integer of up to 38 digits."""
    return (integer_text(value) + n.cast("decimal(38,0)")).cast("string")


def add_long_text(value: Column, n: Column) -> Column:
    """A decimal text of any length plus another, as text; null where one is no integer."""

    @F.arrow_udf("string")
    def added(a, b):
        import re
        import sys

        import pyarrow as pa

        sys.set_int_max_str_digits(0)
        integer = re.compile(r"[+-]?[0-9]+\Z")
        both = ((x, y) for x, y in zip(a.to_pylist(), b.to_pylist()))
        return pa.array([str(int(x) + int(y)) if x and y and integer.match(x) and integer.match(y) else None for x, y in both], pa.string())

    return added(value, n)
