"""The variables of branches, as columns of a compiled definition's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import with_path
from loomgraph.plans.compile import VAR


def keys(rows: DataFrame) -> list[str]:
    """The names of the variables that some row may have, sorted."""
    return sorted(c[len(VAR) :] for c in rows.columns if c.startswith(VAR))


def held(rows: DataFrame) -> Column:
    """The names of the variables that a row has a value of, sorted."""
    return F.array_compact(F.array(*(F.when(F.col(f"`{VAR}{k}`").isNotNull(), k) for k in keys(rows)))) if keys(rows) else F.array().cast("array<string>")


def get(rows: DataFrame, path: str) -> Column:
    """The value at a dotted path; NULL where there is none."""
    name, *rest = path.split(".")
    if VAR + name not in rows.columns:
        return F.lit(None)
    out = F.col(f"`{VAR}{name}`")
    for part in rest:
        out = out[part]
    return out


def put(rows: DataFrame, path: str, value: Column) -> DataFrame:
    """The rows with a value at a dotted path; what is on the way is made, if it isn't there."""
    name, _, rest = path.partition(".")
    if not rest:
        return rows.withColumn(VAR + name, value)
    there = VAR + name in rows.columns
    kind = rows.schema[VAR + name].dataType if there else None
    return rows.withColumn(VAR + name, with_path(F.col(f"`{VAR}{name}`") if there else F.struct(), kind, rest, value))


def delete(rows: DataFrame, name: str) -> DataFrame:
    """The rows without a variable; one that isn't there is no error."""
    return rows.drop(VAR + name)
