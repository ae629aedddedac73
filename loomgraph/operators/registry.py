"""Activities by name: column functions of parameters, or transforms of whole DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import scalars as S
from loomgraph.functions.expressions import Value
from loomgraph.sources import generated as G


Outcome = Callable[[dict[str, Value], list, Column], Column]


@dataclass(frozen=True)
class Activity:
    """column: from typed parameters to a column. frame: from a DataFrame and parameters to a DataFrame and a column of
    it, for what a column can't express, such as a join with a table; it sees all rows, and keeps them. outcome: from
    parameters, retry policies and whether a row is at the step to (value, kind, cause, attempts), kind being NULL where
    it went well; used where a step retries or catches, or where there is no column. python: column takes whether a row is
    at the step as well, as Python would run for all. replay: for activities that wait for signals while they run; takes
    the signals and those that are used as well, and tells what it waits for."""

    name: str
    column: Callable[..., Column] | None = None
    frame: Callable[[DataFrame, dict[str, Value]], tuple[DataFrame, Column]] | None = None
    outcome: Outcome | None = None
    python: bool = False
    replay: Callable[..., Column] | None = None


class Waits(Exception):
    """Ends a call that needs a signal which isn't there; it is begun anew once it is."""

    def __init__(self, topic: str):
        super().__init__(topic)
        self.topic = topic


class Context:
    """What a replayed activity is given: wait() takes the oldest signal of a topic that the execution hasn't used, and once()
    keeps what something came to, so that a call of this row doesn't do it twice."""

    def __init__(self, queue: list, used: list[int]):
        self.queue, self.used = [q for q in queue if q["n"] not in used], list(used)
        self.kept: dict[str, object] = {}

    def wait(self, topic: str):
        for q in self.queue:
            if q["topic"] == topic:
                self.queue.remove(q)
                self.used.append(q["n"])
                return q["payload"]
        raise Waits(topic)

    def once(self, key: str, f: Callable[[], object]):
        if key not in self.kept:
            self.kept[key] = f()
        return self.kept[key]


def retried(once: Callable[[Column], tuple[Column, Column, Column]], retry: list) -> Column:
    """(value, kind, cause, attempts) of what once(attempt) gives as (value, kind, cause), attempts counted from 1. The
    first error picks the policy for all; there are as many attempts more as it says. In the JVM, as one expression."""

    def one(attempt: Column) -> Column:
        value, kind, cause = once(attempt)
        return F.struct(value.alias("value"), kind.cast("string").alias("kind"), cause.cast("string").alias("cause"), attempt.cast("int").alias("attempts"))

    most = max((r.max_retries for r in retry), default=0)
    first = one(F.lit(1))
    if not most:
        return first
    allowed = F.coalesce(F.get(F.array(*(F.lit(r.max_retries) for r in retry)), S.first_policy(first["kind"], [r.errors for r in retry])), F.lit(0))
    begin = F.struct(first.alias("o"), allowed.alias("left"))
    again = lambda acc, n: F.when(acc["o"]["kind"].isNull() | (n > acc["left"] + 1), acc).otherwise(F.struct(one(n).alias("o"), acc["left"].alias("left")))
    return F.aggregate(F.sequence(F.lit(2), F.lit(most + 1)), begin, again)["o"]


class Registry:
    def __init__(self, *activities: Activity):
        self._all: dict[str, Activity] = {}
        for a in activities:
            self.register(a)

    def register(self, a: Activity) -> Activity:
        if not a.name:
            raise ValueError("an activity needs a name")
        if a.name in self._all:
            raise ValueError(f"activity {a.name!r} is registered already")
        self._all[a.name] = a
        return a

    def function(self, name: str):
        """Registers a function of parameter columns by keyword."""

        def add(f: Callable[..., Column]) -> Callable[..., Column]:
            self.register(Activity(name, lambda p: f(**{k: v.column for k, v in p.items()})))
            return f

        return add

    def fallible(self, name: str):
        """Registers a function of parameter columns and attempt, the number of the attempt, to (value, kind, cause): the
        error's type is NULL where it went well."""

        def add(f: Callable[..., tuple[Column, Column, Column]]):
            self.register(Activity(name, outcome=lambda p, retry, active: retried(lambda n: f(**{k: v.column for k, v in p.items()}, attempt=n), retry)))
            return f

        return add

    def rows(self, name: str, returns: str):
        """Registers a function of Python values, run row by row within Arrow batches; for what no column function can
        do. Where the step retries or catches, its exceptions are errors of the row, with pauses between attempts; else
        they end the job."""

        def add(f: Callable):
            def column(p: dict[str, Value], active: Column) -> Column:
                names = list(p)

                @F.pandas_udf(returns)
                def run(rows: pd.DataFrame, here: pd.Series) -> pd.Series:
                    return pd.Series([f(**dict(zip(names, r))) if h else None for r, h in zip(rows.itertuples(index=False), here)], dtype="object")

                return run(F.struct(*(v.column.alias(k) for k, v in p.items())), active)

            def outcome(p: dict[str, Value], retry: list, active: Column) -> Column:
                names = list(p)

                @F.pandas_udf(f"value {returns}, kind string, cause string, attempts int")
                def run(rows: pd.DataFrame, here: pd.Series) -> pd.DataFrame:
                    from loomgraph.plans.runner import attempted

                    out = [attempted(lambda r=r: f(**dict(zip(names, r))), retry) if h else (None, None, None, 0) for r, h in zip(rows.itertuples(index=False), here)]
                    return pd.DataFrame(out, columns=["value", "kind", "cause", "attempts"])

                return run(F.struct(*(v.column.alias(k) for k, v in p.items())), active)

            self.register(Activity(name, column, outcome=outcome, python=True))
            return f

        return add

    def replayed(self, name: str, returns: str):
        """Registers a function of a Context and Python values that may wait for signals. Where one isn't there, its execution
        is suspended, and with a later table of signals the function runs from its begin: it must do the same again. Its
        exceptions are errors of the row."""

        def add(f: Callable):
            def replay(p: dict[str, Value], queue: Column, used: Column, active: Column) -> Column:
                names = list(p)

                @F.pandas_udf(f"value {returns}, kind string, cause string, topic string, used array<int>")
                def run(rows: pd.DataFrame, queue: pd.Series, used: pd.Series, here: pd.Series) -> pd.DataFrame:
                    from loomgraph.plans.runner import classify

                    out = []
                    for r, q, u, h in zip(rows.itertuples(index=False), queue, used, here):
                        c = Context(list(q) if q is not None else [], list(u) if u is not None else [])
                        try:
                            out.append((f(c, **dict(zip(names, r))) if h else None, None, None, None, c.used))
                        except Waits as w:
                            out.append((None, None, None, w.topic, list(u)))
                        except Exception as e:
                            out.append((None, classify(e).kind, classify(e).cause, None, list(u)))
                    return pd.DataFrame(out, columns=["value", "kind", "cause", "topic", "used"])

                params = F.struct(*(v.column.alias(k) for k, v in p.items())) if p else F.struct(F.lit(0).alias("_none"))
                return run(params, queue, used, active)

            self.register(Activity(name, replay=replay))
            return f

        return add

    def typed(self, name: str, schema: str):
        """Registers a function of one struct of a schema: parameters are cast to its fields, those that lack are NULL, and
        those that it doesn't have are errors of the plan."""
        fields = T.StructType.fromDDL(schema)

        def add(f: Callable[[Column], Column]):
            def column(p: dict[str, Value]) -> Column:
                if unknown := sorted(set(p) - set(fields.names)):
                    raise ValueError(f"{name}: unknown parameters {unknown}")
                return f(F.struct(*((p[x.name].column if x.name in p else F.lit(None)).cast(x.dataType).alias(x.name) for x in fields)))

            self.register(Activity(name, column))
            return f

        return add

    def get(self, name: str) -> Activity:
        if name not in self._all:
            raise KeyError(f"no activity {name!r}")
        return self._all[name]

    def names(self) -> list[str]:
        return sorted(self._all)


def _string(v: Value) -> Column:
    return v.column if isinstance(v.kind, T.StringType) else F.to_json(v.column)


def _json(p: dict[str, Value], strict: bool = True) -> Column:
    """The operation parse, stringify, query, merge or validate, which is a constant."""
    op, text = p["operation"].const, lambda k: _string(p[k])
    if op == "parse":
        return F.parse_json(text("data")) if strict else F.try_parse_json(text("data"))
    if op == "stringify":
        return S.json_stringify(text("data") if strict else F.when(S.json_validate(text("data")), text("data")))
    if op == "query":
        return S.json_query(text("data"), str(p["query"].const), strict=strict)
    if op == "merge":
        left, right = (text(k) if strict else F.when(S.json_validate(text(k)), text(k)) for k in ("left", "right"))
        return S.json_merge(left, right)
    if op == "validate":
        return S.json_validate(text("data"))
    raise ValueError(f"unknown operation {op!r}")


def _json_outcome(p: dict[str, Value], retry: list, active: Column) -> Column:
    value = _json(p, strict=False)
    return retried(lambda n: (value, F.when(value.isNull(), S.FAILED), F.when(value.isNull(), F.concat(F.lit(f"{p['operation'].const}: "), F.coalesce(_string(p["data"] if "data" in p else p["left"]), F.lit("null"))))), [])


def _print(p: dict[str, Value]) -> Column:
    """message, or message as a form of args; of other parameters, all joined."""
    if set(p) == {"message", "args"}:
        args = p["args"]
        n = len(args.items or ())
        return S.printed(str(p["message"].const), *(v.column for v in args.items)) if n else p["message"].column
    return _string(p["message"]) if set(p) == {"message"} else F.concat(*(_string(v) for v in p.values()))


def _random(make: Callable[[dict[str, Value]], Column]) -> Callable[[dict[str, Value]], Column]:
    """With a constant count over 1, an array of so many."""
    return lambda p: G.several(lambda: make(p), int(p["count"].const) if "count" in p else 1)


def _number(p: dict[str, Value]) -> Column:
    low = p["min"].column if "min" in p else F.lit(0)
    high = p["max"].column if "max" in p else low + 100
    return (F.floor(F.rand() * (high - low + 1)) + low).cast("bigint")


def _float(p: dict[str, Value]) -> Column:
    low, high = (p[k].column if k in p else F.lit(d) for k, d in (("min", 0.0), ("max", 1.0)))
    return F.rand() * (high - low) + low


def builtin() -> Registry:
    """print, json, time, fail, random.* and noop."""
    r = Registry()
    r.register(Activity("print", _print))
    r.register(Activity("json", _json, outcome=_json_outcome))
    r.register(Activity("time", lambda p: F.current_timestamp()))
    r.fallible("fail")(lambda attempt, message=None: (F.lit(None).cast("string"), F.lit(S.FAILED), F.lit("failed") if message is None else message))
    r.register(Activity("noop", lambda p: next((v.column for v in p.values()), F.lit(None).cast("string"))))
    length = lambda p, n: int(p["length"].const) if "length" in p else n
    r.register(Activity("random.number", _random(_number)))
    r.register(Activity("random.float", _random(_float)))
    r.register(Activity("random.string", _random(lambda p: G.string(length(p, 10), str(p["charset"].const) if "charset" in p else G.LETTERS))))
    r.register(Activity("random.alphanumeric", _random(lambda p: G.alphanumeric(length(p, 8)))))
    r.register(Activity("random.hex", _random(lambda p: G.hexadecimal(length(p, 8)))))
    r.register(Activity("random.uuid", _random(lambda p: F.uuid())))
    r.register(Activity("random.boolean", _random(lambda p: F.rand() < 0.5)))
    r.register(Activity("random.choice", _random(lambda p: F.element_at(p["choices"].column, (F.floor(F.rand() * F.size(p["choices"].column)) + 1).cast("int")))))
    return r


def mock(name: str, result) -> Activity:
    """An activity that gives the same value for every row."""
    return Activity(name, lambda p: F.lit(result))


def mock_error(name: str, message: str, kind: str = S.FAILED) -> Activity:
    """An activity that fails for every row, with an error of a type."""
    return Activity(name, outcome=lambda p, retry, active: retried(lambda n: (F.lit(None).cast("string"), F.lit(kind), F.lit(message)), retry))
