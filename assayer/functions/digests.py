"""Deterministic hashes; the same values come out of any engine with md5 and sha256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_hash(key, salt: str = "") -> Column:
    """md5 of the key columns joined by '|', the salt in front when there is one."""
    parts = [_col(k).cast("string") for k in key]
    return F.md5(F.concat_ws("|", *([F.lit(salt)] if salt else []), *parts))


def hash_number(h: Column) -> Column:
    """First 32 bits of an md5 as a number."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def uniform(key, salt: str = "") -> Column:
    """Number in [0, 1) fixed by the key and the salt."""
    return hash_number(key_hash(key, salt)) / F.lit(4294967296.0)


def stable_text(field: T.StructField) -> Column:
    """Text of a cell that does not depend on how an engine prints doubles."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.coalesce(c.cast("decimal(38,6)").cast("string"), F.lit(""))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))
