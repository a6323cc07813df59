"""Scalar expressions over the operation log: sizes, text views, capacities, padded keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WRITE, DELETE = "W", "D"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_size(key: Column | str = "key", op: Column | str = "op", value: Column | str = "value") -> Column:
    """Bytes of a stored record: id, key length, key, tag, and for writes value length and value."""
    return (F.lit(17) + F.octet_length(col(key)) + F.when(col(op) == WRITE, F.lit(8) + F.octet_length(col(value))).otherwise(0)).cast("long")


def request_size(key: Column | str = "key", op: Column | str = "op", value: Column | str = "value") -> Column:
    """Bytes of a record in a write request, which carries no id."""
    return (encode_size(key, op, value) - 8).cast("long")


def byte_length(c: Column | str) -> Column:
    return F.octet_length(col(c))


def lossy_text(c: Column | str) -> Column:
    """Bytes as text; bad bytes are replaced rather than refused."""
    return col(c).cast("string")


def payload_crc(c: Column | str) -> Column:
    return F.crc32(col(c).cast("binary"))


def level_capacity(level: Column | str, limit: int, ratio: int) -> Column:
    """Files that a level may hold."""
    return F.round(F.lit(limit) * F.pow(F.lit(ratio), col(level))).cast("long")


def padded(c: Column | str, width: int = 6) -> Column:
    """Zero-padded decimal; wider numbers raise instead of being cut."""
    text = col(c).cast("string")
    return F.when(F.length(text) <= width, F.lpad(text, width, "0")).otherwise(F.raise_error(F.concat(F.lit("number too wide: "), text)).cast("string"))
