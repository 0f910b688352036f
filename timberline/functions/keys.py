"""Scalar functions over keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def common_prefix_length(a: str, b: str) -> Column:
    """Length of the longest common prefix; 0 if either is empty."""
    n = F.least(F.length(a), F.length(b))
    same = lambda i: F.substring(F.col(a), F.lit(1), i) == F.substring(F.col(b), F.lit(1), i)
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), same))).otherwise(0)


def raw_length(key: str = "key") -> Column:
    """Bytes of a key with its 8-byte timestamp."""
    return F.octet_length(key) + 8


def padded(number: Column, width: int) -> Column:
    return F.format_string(f"%0{width}d", number)


def file_name(file_id: Column) -> Column:
    return F.concat(F.format_string("%05d", file_id), F.lit(".sst"))


def be64_encode(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def be64_decode(data: Column) -> Column:
    """A signed number, so that it inverts be64_encode for every BIGINT: bytes from 2^63 on are negative."""
    return F.conv(F.hex(data), 16, -10).cast("long")
