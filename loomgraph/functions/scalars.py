"""Scalar functions as columns: backoff, waits, errors, identifiers, JSON, formats."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def backoff(attempt: Column, base: float = 1.0, rate: float = 2.0, cap: float | None = None, jitter: bool = False) -> Column:
    """Seconds before the attempt after this one, counted from 1: base * rate**(attempt - 1), at most cap. With full
    jitter, any number from 0 to that. A delay that isn't positive is the base."""
    delay = F.lit(float(base)) * F.pow(F.lit(float(rate)), attempt.cast("double") - 1)
    if cap is not None and cap > 0:
        delay = F.least(delay, F.lit(float(cap)))
    delay = F.when(delay > 0, delay).otherwise(F.lit(float(base)))
    return F.rand() * delay if jitter else delay


def remaining(wake_at: Column, now: Column) -> Column:
    """Microseconds of a wait that is frozen now: none if it is over."""
    return F.greatest(F.timestamp_diff("MICROSECOND", now, wake_at), F.lit(0).cast("bigint"))


def thawed(now: Column, micros: Column) -> Column:
    """When a wait with so many microseconds left, thawed now, ends."""
    return F.timestamp_add("MICROSECOND", micros, now)


def deadline(start: Column, seconds: Column) -> Column:
    """So many seconds, which may have a fraction, after the start."""
    return F.timestamp_add("MICROSECOND", F.round(seconds.cast("double") * 1e6).cast("bigint"), start)


FATAL, TIMEOUT, FAILED = "fatal_error", "timeout", "activity_failed"


def matches_error(kind: Column, pattern: Column, fenced: Column | None = None) -> Column:
    """Whether an error of this type meets a pattern: "all" means any but fatal ones, "activity_failed" any but
    timeouts and fatal ones, others themselves. A lost lease (fenced) meets none."""
    out = F.when(kind == FATAL, pattern == FATAL).when(pattern == "all", True).when(pattern == FAILED, kind != TIMEOUT).otherwise(kind == pattern)
    return F.coalesce(out if fenced is None else F.when(fenced, False).otherwise(out), F.lit(False))


def classify(code: Column) -> Column:
    """The type of an error code: deadlines and wait timeouts are timeouts, a type stays itself, all else, cancelling
    too, is activity_failed."""
    return F.when(code.isin("deadline_exceeded", "wait_timeout"), TIMEOUT).when(code.isin(TIMEOUT, FATAL, FAILED), code).otherwise(FAILED)


def first_policy(kind: Column, policies: list[list[str]], empty: list[str] = ["all"]) -> Column:
    """The place, from 0, of the first policy with a pattern that the error meets; NULL if none. An empty list stands for
    ["all"] in policies of retries, for none in handlers."""
    out = F.lit(None).cast("int")
    for i in range(len(policies) - 1, -1, -1):
        hit = F.lit(False)
        for p in policies[i] or empty:
            hit = hit | matches_error(kind, F.lit(p))
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def error_record(kind: Column, cause: Column, details: Column) -> Column:
    return F.struct(kind.alias("Error"), cause.alias("Cause"), details.alias("Details"))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_identifier(c: Column) -> Column:
    """ASCII letters, digits and underscores, not beginning with a digit."""
    return F.coalesce(c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def permissions(c: Column, default: int = 0o644) -> Column:
    """A file mode: octal if it begins with 0, else decimal; the default if it is no number."""
    octal = F.conv(F.substring(c, 2, 20), 8, 10).cast("int")
    return F.when(c.rlike(r"^0[0-7]+$"), octal).when(c.rlike(r"^[1-9][0-9]{0,8}$"), c.try_cast("int")).otherwise(F.lit(default))


def minted(prefix: str, *key: Column) -> Column:
    """An identifier that is a function of a natural key: the prefix and 26 hexadecimal digits."""
    bits = F.sha2(F.to_json(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))), 256)
    return F.concat(F.lit(prefix), F.substring(bits, 1, 26))


BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def execution_id(*key: Column) -> Column:
    """An execution's identifier, a function of a natural key: exec_ and 26 signs of base 32."""
    bits = F.sha2(F.to_json(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))), 256)
    # one sign for each two hexadecimal digits, of which it takes five bits
    signs = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(bits, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % 32 + 1, F.lit(1)))
    return F.concat(F.lit("exec_"), F.array_join(signs, ""))


def to_utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_utc_text(c: Column) -> Column:
    return F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def each_value(value: Column, kind: T.DataType) -> Column:
    """The items of a value: an array's elements, a map's {key, value} by key, a scalar alone; NULL has none."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(value, F.array().cast(kind))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.array_sort(F.map_entries(value)), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))))
    return F.when(value.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(value))


def metadata_json(m: Column) -> Column:
    """A map of texts as JSON; an empty one as NULL."""
    return F.when(F.size(m) > 0, F.to_json(m))


def metadata_map(c: Column) -> Column:
    return F.from_json(c, "map<string,string>")


def contains(m: Column, wanted: dict[str, str]) -> Column:
    """Whether a map has all these entries; of none, any map has them."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(m[k] == F.lit(v), F.lit(False))
    return out


def checked(c: Column, allowed: list[str], what: str) -> Column:
    """A text that must be one of a few; another one is an error when it is read. NULL stays."""
    return F.when(c.isNull() | c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} "), c)).cast("string"))


def with_path(value: Column, kind: T.DataType, path: str, new: Column) -> Column:
    """A struct or map with the field at a dotted path set: structs on the way that aren't there are made, and take the place
    of what is no struct or map. A path with an empty part changes nothing."""
    parts = path.split(".")
    if not all(parts):
        return value

    def put(v: Column | None, k: T.DataType | None, rest: list[str]) -> Column:
        if not rest:
            return new
        if isinstance(k, T.MapType):
            return F.map_concat(F.map_filter(v, lambda name, _: name != rest[0]), F.create_map(F.lit(rest[0]), put(v[rest[0]], k.valueType, rest[1:])))
        names = k.names if isinstance(k, T.StructType) else []
        out = [put(v[n], k[n].dataType, rest[1:]).alias(n) if n == rest[0] else v[n].alias(n) for n in names]
        if rest[0] not in names:
            out.append(put(None, None, rest[1:]).alias(rest[0]))
        return F.struct(*out)

    return put(value, kind, parts)


# JSON. Queries by path stay in the JVM; what needs a whole document goes to Python in Arrow batches.


def json_path(query: str) -> str:
    """A dotted path, empty segments left out and numeric ones as indexes, as a JSON path."""
    out = "$"
    for part in filter(None, query.split(".")):
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def json_query(doc: Column, query: str, strict: bool = False) -> Column:
    """The value at a path, as text; where there is none, NULL, or, strictly, an error."""
    got = F.get_json_object(doc, json_path(query))
    if not strict:
        return got
    return F.when(got.isNull() & doc.isNotNull(), F.raise_error(F.concat(F.lit(f"no value at {query!r} in "), doc))).otherwise(got)


def _strict(_: str):
    raise ValueError


def _load(s):
    return json.loads(s, parse_constant=_strict)


@F.pandas_udf(T.BooleanType())
def json_validate(doc: pd.Series) -> pd.Series:
    """Whether a text is one JSON value; the empty text and one with more after the value aren't; NULL for NULL."""

    def ok(s):
        if s is None:
            return None
        try:
            _load(s)
        except ValueError:
            return False
        return True

    return doc.map(ok).astype("object")


@F.pandas_udf(T.StringType())
def json_stringify(doc: pd.Series) -> pd.Series:
    """A document with two blanks for each level and its keys sorted; an invalid one is an error."""
    return doc.map(lambda s: None if s is None else json.dumps(_load(s), indent=2, sort_keys=True, ensure_ascii=False))


def _merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: _merged(a[k], v) if k in a else v for k, v in b.items()}}
    return b


@F.pandas_udf(T.StringType())
def json_merge(left: pd.Series, right: pd.Series) -> pd.Series:
    """Two objects as one, recursively; of two values the right one stays, even null. NULL if either is NULL."""
    return pd.Series([None if a is None or b is None else json.dumps(_merged(_load(a), _load(b)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for a, b in zip(left, right)], dtype="object")


def json_parse(doc: Column, schema: str | None = None) -> Column:
    """A document as VARIANT, or of a schema; an invalid one is an error, or NULL with a schema."""
    return F.parse_json(doc) if schema is None else F.from_json(doc, schema)


def printed(form: str, *values: Column) -> Column:
    """A printf-like text, by a constant form. %v, %+v and %q stand for any value, %t for booleans, %d for whole numbers;
    %% is a sign; other verbs are those of the JVM."""
    form = re.sub(r"%([-+ 0-9.]*)([vtq])", lambda m: f'"%{m[1].strip("+ ")}s"' if m[2] == "q" else f"%{m[1].strip('+ ')}s", form)
    return F.format_string(form, *values)
