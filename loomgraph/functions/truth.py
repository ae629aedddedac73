"""Truthiness and number formatting, as columns that depend on a value's type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(value: Column, kind: T.DataType) -> Column:
    """Two-valued truth: NULL is false; numbers are true unless 0 (NaN is true); strings unless empty or "false" in any
    case; collections unless empty; anything else is true."""
    if isinstance(kind, T.NullType):
        return F.lit(False)
    if isinstance(kind, T.BooleanType):
        out = value
    elif isinstance(kind, T.NumericType):
        out = value != F.lit(0)
    elif isinstance(kind, T.StringType):
        out = (value != "") & (F.lower(value) != "false")
    elif isinstance(kind, T.ArrayType | T.MapType):
        out = F.size(value) > 0
    else:
        out = value.isNotNull()
    return F.coalesce(out, F.lit(False))


def text(value: Column, kind: T.DataType) -> Column:
    """A value as text; NULL as the empty text, whole doubles without a fraction, booleans in lower case."""
    if isinstance(kind, T.NullType):
        return F.lit("")
    if isinstance(kind, T.FloatType | T.DoubleType):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        out = F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))
    elif isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        out = F.to_json(value)
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit(""))
