"""Definitions compiled into one DataFrame plan: each row is a branch of an execution, and says at which step it is.

Steps are walked in topological order, each once. A step changes the columns of the rows that are at it, by CASE
expressions over the one frame, so its input is scanned once however the graph forks and merges. Only where several
edges may be followed are rows multiplied, by one explode. Joins and shared signals look at an execution's other rows
through windows over its key, which all need one and the same exchange. Definitions with cycles are walked in passes
until no row is on its way; between passes a checkpoint cuts the plan, and what has ended isn't carried along.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import expressions as X
from loomgraph.functions import scalars as S
from loomgraph.functions.truth import text
from loomgraph.operators import runs as R
from loomgraph.operators.registry import Registry, builtin
from loomgraph.plans.spec import Definition, Definitions, InvalidDefinition, Step

KEY, BRANCH = "exec_id", "branch_id"
IN, VAR = "i__", "s__"
#: The step that a row is at (NULL once its branch has ended), the step it ended at, and how; the error if it failed;
#: why, until when and for what it waits; the time of the branch; the signals it has used.
AT, LAST, STATUS, ERROR, REASON, WAKE, TOPIC, CLOCK, USED = "at__", "at_step", "status__", "error__", "reason__", "wake__", "topic__", "clock__", "used__"
#: Before the name of a variable that is an output: whether the branch has it, be it NULL.
SET = "set__"
ERROR_TYPE = "struct<Error:string,Cause:string,Details:string>"
#: A definition of more steps has filters on its results kept above its plan: pushed down, each would be written out
#: anew for both sides of every CASE beneath, twice as long with each step.
LONG = 8
#: Passes of a cyclic definition between two checkpoints, at most.
PASSES = 8


class Compiled:
    """outputs: a row for each execution that has completed. executions: a row for each execution, with its status, its
    error and its outputs; one that ends without a declared output has failed. branches: the branches that have
    completed, by the step they ended at. suspended: those that wait, with a reason. failed: those that have failed,
    with the error. steps: the rows as each step left them. Each is built when it is first asked for."""

    def __init__(self, compiler: Compiler, frame: DataFrame):
        self.definition, self._compiler, self._frame = compiler.d, compiler, frame
        self._state = [KEY, *(c for c in frame.columns if c.startswith((IN, VAR))), BRANCH]

    @cached_property
    def branches(self) -> DataFrame:
        return self._frame.where(F.col(STATUS) == "completed").select(*self._state, LAST)

    @cached_property
    def suspended(self) -> DataFrame:
        waiting = self._frame.where(F.col(STATUS).isin("suspended", "paused"))
        return waiting.select(*self._state, LAST, F.col(REASON).alias("reason"), F.col(WAKE).alias("wake_at"), F.col(TOPIC).alias("topic"))

    @cached_property
    def failed(self) -> DataFrame:
        return self._frame.where(F.col(STATUS) == "failed").select(*self._state, LAST, F.col(ERROR).alias("error"))

    @cached_property
    def executions(self) -> DataFrame:
        return self._compiler._executions(self._frame)

    @cached_property
    def outputs(self) -> DataFrame:
        return self._compiler._outputs(self._frame, self)

    @cached_property
    def steps(self) -> dict[str, DataFrame]:
        return {name: make() for name, make in self._compiler.steps.items()}

    def strict(self) -> DataFrame:
        """outputs of all executions; one that hasn't completed is an error when it is read."""
        e = self.executions
        ok = F.when(F.col("status") == "completed", F.col(KEY)).otherwise(F.raise_error(F.concat(F.lit("execution "), F.col(KEY).cast("string"), F.lit(" is "), F.col("status"))))
        return e.withColumn(KEY, ok.cast(e.schema[KEY].dataType)).select(KEY, *(o.name for o in self.definition.outputs))


def _checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder that the session names; without one, on one machine only, in a
    temporary folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def scope_of(df: DataFrame, names: set[str] | None = None, bound: dict[str, X.Value] | None = None, engine: X.Engine | None = None) -> X.Scope:
    """Where paths lead in rows of a definition: its inputs, and the variables of these names, or all."""
    state = {c[len(VAR) :]: c for c in df.columns if c.startswith(VAR)}
    return X.Scope(df, {c[len(IN) :]: c for c in df.columns if c.startswith(IN)}, state if names is None else {n: c for n, c in sorted(state.items()) if n in names}, bound, engine)


def _reduced(f, columns: list[Column], none: Column) -> Column:
    return reduce(f, columns) if columns else none


class Compiler:
    """signals: (exec_id, topic, payload, ts). now: a literal time for waits; without, the current time. engine: what makes
    a value of an expression's code and a scope, in place of the language of functions.expressions. definitions: those
    that the activity "child" may run."""

    def __init__(self, definition: Definition, registry: Registry | None = None, signals: DataFrame | None = None, now=None, max_rounds: int = 1000, engine: X.Engine | None = None, definitions: Definitions | None = None):
        self.d, self.registry = definition.validate(), registry or builtin()
        self.signals, self.max_rounds, self.engine, self.definitions = signals, max_rounds, engine, definitions
        self.now = F.current_timestamp() if now is None else F.lit(now)
        self.children: list[str] = []
        self.tracked = {(o.variable or o.name).split(".")[0] for o in self.d.outputs}

    # what a walk knows beside the frame

    def _begin(self) -> None:
        self.visible: dict[str, set[str]] = {self.d.first.name: set(self.d.state)}
        self.reached: set[str] = {self.d.first.name}
        self.all_here = True  # all rows are at the step that comes now
        self.forked = False  # executions may have several rows
        self.fallible = False  # rows may fail
        self.steps: dict[str, Callable[[], DataFrame]] = {}

    def _scope(self, df: DataFrame, step: Step, bound: dict[str, X.Value] | None = None, only: set[str] | None = None) -> X.Scope:
        return scope_of(df, self.visible[step.name] if only is None else only, bound, self.engine)

    def _set(self, df: DataFrame, when: Column | None, values: dict[str, Column]) -> DataFrame:
        """df with columns set on the rows where it is so (on all, without when). A column that is new is NULL elsewhere;
        one of another type becomes text, unless both are numbers."""
        out, there = {}, set(df.columns)
        for name, new in values.items():
            if when is None:
                out[name] = new
            elif name not in there:
                out[name] = F.when(when, new)
            else:
                old = F.col(f"`{name}`")
                if name.startswith(VAR):  # the others have one type
                    had, got = df.schema[name].dataType, df.select(new.alias("x")).schema["x"].dataType
                    # the types are compared without NULLs
                    numbers = isinstance(had, T.NumericType) and isinstance(got, T.NumericType)
                    if had.simpleString() != got.simpleString() and not numbers and not isinstance(had, T.NullType) and not isinstance(got, T.NullType):
                        old, new = text(old, had), text(new, got)
                out[name] = F.when(when, new).otherwise(old)
            if name[len(VAR) :] in self.tracked and name.startswith(VAR):
                out[SET + name] = F.lit(True) if when is None else F.when(when, True).otherwise(F.col(f"`{SET}{name}`"))
        return df.withColumns(out)

    # one step

    def _body(self, step: Step, df: DataFrame, here: Column | None) -> DataFrame:
        """The step's activity, for each item if it has them, and where the result is stored. Rows that fail go to the
        handler that catches the error, or have failed."""
        if not step.activity:
            return df
        if step.activity == "child" and self.definitions is not None:
            return self._child(step, df, here)
        activity = self.registry.get(step.activity)
        replays = activity.replay is not None
        fails = replays or activity.outcome is not None and (activity.column is None or bool(step.retry or step.catch))
        if step.each:
            if activity.column is None or activity.python or replays:
                raise InvalidDefinition([f"step {step.name!r}: {step.activity!r} can't be run for each item"])
            items = self._items(step, df)

            def one(item: Column) -> Column:
                scope = self._scope(df, step, {step.each.as_: X.Value(item, items.kind.elementType)})
                return activity.column({k: X.parameters(v, scope) for k, v in step.parameters.items()})

            result = F.transform(items.column, one)
        else:
            scope = self._scope(df, step)
            params = {k: X.parameters(v, scope) for k, v in step.parameters.items()}
            active = F.lit(True) if here is None else here
            if replays:
                if "queue__" not in df.columns:
                    raise InvalidDefinition([f"step {step.name!r} may wait for signals, but there is no table of them"])
                used = F.array_distinct(F.flatten(F.collect_list(F.col(USED)).over(self._of_execution()))) if self.forked else F.col(USED)
                come = F.filter("queue__", lambda q: q["ts"] <= self.now)
                df = df.withColumn("_o", activity.replay(params, come, used, active))
                result = F.col("_o.value")
                waits = F.col("_o.topic").isNotNull() if here is None else here & F.col("_o.topic").isNotNull()
                df = self._set(df, waits, {AT: F.lit(None).cast("string"), LAST: F.lit(step.name), STATUS: F.lit("suspended"), REASON: F.lit("waiting_signal"), TOPIC: F.col("_o.topic")})
                df = self._set(df, None if here is None else F.col(AT) == step.name, {USED: F.col("_o.used")})
                here = F.col(AT) == step.name
                self.all_here = False
            elif activity.frame:
                df, result = activity.frame(df, params)
            elif fails:
                df = df.withColumn("_o", activity.outcome(params, step.retry, active))
                result = F.col("_o.value")
            else:
                result = activity.column(params, active) if activity.python else activity.column(params)
        if not fails:
            return self._set(df, here, {VAR + step.store: result}) if step.store else self._set(df, here, {"_done": result}).drop("_done")
        self.fallible = True
        bad = F.col("_o.kind").isNotNull() if here is None else here & F.col("_o.kind").isNotNull()
        good = F.col("_o.kind").isNull() if here is None else here & F.col("_o.kind").isNull()
        if step.store:
            df = self._set(df, good, {VAR + step.store: result})
        record = S.error_record(F.col("_o.kind"), F.col("_o.cause"), F.lit(None).cast("string")).cast(ERROR_TYPE)
        chosen = S.first_policy(F.col("_o.kind"), [c.errors for c in step.catch], empty=[]) if step.catch else F.lit(None).cast("int")
        df = df.withColumn("_c", F.when(bad, chosen))
        df = self._set(df, bad & F.col("_c").isNull(), {AT: F.lit(None).cast("string"), LAST: F.lit(step.name), STATUS: F.lit("failed"), ERROR: record})
        for i, c in enumerate(step.catch):
            mine = bad & (F.col("_c") == i)
            if c.store:
                df = self._set(df, mine, {VAR + c.store: record})
            df = self._set(df, mine, {AT: F.lit(c.next)})
            self._reach(c.next, self.visible[step.name] | ({c.store} if c.store else set()))
        self.all_here = False
        return df.drop("_o", "_c")

    def _items(self, step: Step, df: DataFrame) -> X.Value:
        items, scope = step.each.items, self._scope(df, step)
        if isinstance(items, str):
            code = items.strip()
            v = X.evaluate(code[2:-1] if code.startswith("${") and code.endswith("}") else code, scope)
        elif isinstance(items, list):
            v = X.parameters(items, scope)
        else:
            v = X.parameters([items], scope)
        each = S.each_value(v.column, v.kind)
        kind = v.kind
        if isinstance(kind, T.MapType):
            kind = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        elif not isinstance(kind, T.ArrayType):
            kind = T.ArrayType(kind)
        return X.Value(each, kind)

    def _child(self, step: Step, df: DataFrame, here: Column | None) -> DataFrame:
        """Runs a registered definition for the rows that are at the step; what it is stored as has the child's outputs, its
        status, its error, and whether it was a success. The child shares the registry and the engine, not the signals.
        Definitions may not run each other in a circle."""
        name = step.parameters.get("definition")
        d = self.definitions.get(name)
        if name in self.children or name == self.d.name:
            raise InvalidDefinition([f"step {step.name!r}: definition {name!r} runs itself"])
        child = Compiler(d, self.registry, None, max_rounds=self.max_rounds, engine=self.engine, definitions=self.definitions)
        child.now, child.children = self.now, [*self.children, self.d.name]
        scope = self._scope(df, step)
        given = {k: X.parameters(v, scope).column for k, v in (step.parameters.get("inputs") or {}).items()}
        bound = d.bind(dict.fromkeys(given, True))
        whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_parent")
        begin = F.lit(d.first.name) if here is None else F.when(here, d.first.name)
        rows = df.select(F.struct(KEY, BRANCH).alias(KEY), whole, F.col(CLOCK), *(given[k].alias(IN + k) if k in given else F.lit(v).alias(IN + k) for k, v in bound.items()), begin.alias(AT))
        done = child._run(child._frame(rows, ["_parent"], None if here is None else F.col(AT)))
        got = child._executions(done, carry=["_parent"])
        result = F.struct(F.struct(*(F.col(f"`{o.name}`") for o in d.outputs)).alias("outputs") if d.outputs else F.lit(None).cast("string").alias("outputs"), F.col("status"), F.col("error"), (F.col("status") == "completed").alias("success"))
        out = got.select("_parent", result.alias("_r")).select(*(F.col("_parent")[c].alias(c) for c in df.columns), "_r")
        if here is not None:
            here = F.col(AT) == step.name
        return (self._set(out, here, {VAR + step.store: F.col("_r")}) if step.store else out).drop("_r")

    def _reach(self, name: str, names: set[str]) -> None:
        self.reached.add(name)
        self.visible[name] = self.visible.get(name, set()) | names

    def _route(self, step: Step, df: DataFrame, here: Column | None, only: set[str] | None = None) -> DataFrame:
        """Each row goes to the step of the edge it follows. A branch ends where it follows no edge, several, or one into a
        branch of its own name; in the last two cases each edge begins a branch."""
        none = F.lit(None).cast("string")
        ended = {AT: none, LAST: F.lit(step.name), STATUS: F.lit("completed")}
        stored = self.visible[step.name] | {s for s in (step.store, step.wait_signal.store if step.wait_signal else "") if s}
        if not step.next:
            return self._set(df, here, ended)
        holds = [X.predicate(e.condition, self._scope(df, step, only=only if only is not None else stored)) for e in step.next]
        if step.edge_matching == "first":
            taken = F.lit(False)
            for i, h in enumerate(holds):
                holds[i] = h & ~taken
                taken = taken | h
        for e in step.next:
            self._reach(e.step, stored)
        plain = len(step.next) == 1 and not (step.next[0].condition or "").strip()
        # of conditions that exclude each other at most one holds
        single = step.edge_matching == "first" or len(step.next) == 1
        if single and not any(e.branch for e in step.next):
            if plain:
                return self._set(df, here, {AT: F.lit(step.next[0].step)})
            to = none
            for e, h in reversed(list(zip(step.next, holds))):
                to = F.when(h, e.step).otherwise(to)
            df = df.withColumn("_to", to if here is None else F.when(here, to))
            over = F.col("_to").isNull() if here is None else here & F.col("_to").isNull()
            moved = self._set(df, here, {AT: F.col("_to")})
            return self._set(moved, over, {LAST: F.lit(step.name), STATUS: F.lit("completed")}).drop("_to")
        marks = [f"_e{i}" for i in range(len(holds))]
        df = df.withColumns(dict(zip(marks, holds)))
        n = _reduced(lambda a, b: a + b, [F.col(m).cast("int") for m in marks], F.lit(0))
        unnamed = _reduced(lambda a, b: a | b, [F.col(m) for m, e in zip(marks, step.next) if not e.branch], F.lit(False))
        stays = (n == 1) & unnamed

        def move(to: Column, branch: Column, last: Column, status: Column) -> Column:
            return F.struct(to.alias(AT), branch.alias(BRANCH), last.alias(LAST), status.alias(STATUS))

        as_is = move(*(F.col(c) for c in (AT, BRANCH, LAST, STATUS)))
        ends = move(none, F.col(BRANCH), F.lit(step.name), F.lit("completed"))
        moves = [F.when(~stays, ends)]
        for i, e in enumerate(step.next):
            name = F.lit(e.branch) if e.branch else F.when(stays, F.col(BRANCH)).otherwise(F.concat(F.col(BRANCH), F.lit(f"-{step.name}-{i + 1}")))
            moves.append(F.when(F.col(marks[i]), move(F.lit(e.step), name, F.col(LAST), F.col(STATUS))))
        moves_ = F.array_compact(F.array(*moves))
        df = df.withColumn("_m", F.explode(moves_ if here is None else F.when(here, moves_).otherwise(F.array(as_is))))
        self.forked = True
        return df.withColumns({c: F.col(f"_m.{c}") for c in (AT, BRANCH, LAST, STATUS)}).drop("_m", *marks)

    def _of_execution(self) -> Any:
        return Window.partitionBy(KEY)

    def _join(self, step: Step, df: DataFrame, here: Column | None) -> tuple[DataFrame, Column, set[str]]:
        """(the frame, which rows go on, the names that were merged). Rows at the step whose execution isn't ready wait, and
        so do those whose place a later branch has taken."""
        j, w = step.join, self._of_execution()
        here = F.lit(True) if here is None else here
        df = df.withColumn("_here", here)
        done = (F.col(STATUS) == "completed") & F.col(AT).isNull()
        variables = [c for c in df.columns if c.startswith(VAR)]
        last = F.max(F.when(F.col("_here"), F.col(BRANCH))).over(w) == F.col(BRANCH)
        merged: dict[str, Column] = {}
        names: set[str] = set()
        new = {}
        if not j.branches:
            ready = F.count_if(done).over(w) >= (j.count or 2)
            for i, c in enumerate(variables):
                # of a variable that several branches have, the last branch's by name counts
                new[f"_m{i}"] = F.max_by(F.col(f"`{c}`"), F.when(done & F.col(f"`{c}`").isNotNull(), F.col(BRANCH))).over(w)
                merged[c] = F.coalesce(F.col(f"_m{i}"), F.col(f"`{c}`"))
                names.add(c[len(VAR) :])
        else:
            ready = F.lit(True)
            for b in j.branches:
                mine = done & (F.col(BRANCH) == b)
                ready = ready & (F.count_if(mine).over(w) > 0)
                state = F.struct(*(F.col(f"`{c}`").alias(c[len(VAR) :]) for c in variables))
                for source, dest in ({s: d for s, d in j.mappings.items() if s == b or s.startswith(b + ".")} or {b: b}).items():
                    path = source.split(".")[1:]
                    if path and VAR + path[0] not in variables:
                        continue  # a variable that isn't there is left out
                    value = reduce(lambda c, p: c[p], path[1:], F.col(f"`{VAR + path[0]}`")) if path else state
                    at = f"_m{len(new)}"
                    new[at] = F.first(F.when(mine, value), ignorenulls=True).over(w)
                    merged[VAR + dest] = F.col(at)
                    names.add(dest)
        df = df.withColumns({**new, "_last": last, "_ready": ready})
        df = df.withColumn("_go", F.col("_here") & F.col("_ready") & F.col("_last"))
        df = self._set(df, F.col("_go"), merged)
        df = self._set(df, F.col("_here") & ~F.col("_go"), {AT: F.lit(None).cast("string"), LAST: F.lit(step.name), STATUS: F.lit("suspended"), REASON: F.lit("waiting_join")})
        self.visible[step.name] = self.visible[step.name] | names
        return df.drop("_here", "_last", "_ready", *new), F.col("_go"), names

    def _wait(self, step: Step, df: DataFrame, here: Column | None) -> tuple[DataFrame, Column]:
        """(the frame, which rows go on) of a step that waits; other rows at it are suspended, go where a time-out leads, or
        have failed by it."""
        here = F.lit(True) if here is None else here
        df = df.withColumn("_here", here)
        here = F.col("_here")
        none = F.lit(None).cast("string")
        start = F.coalesce(F.col(CLOCK), self.now)
        park = {AT: none, LAST: F.lit(step.name), STATUS: F.lit("suspended")}
        self.all_here = False
        if step.kind == "pause":
            df = self._set(df, here, {**park, STATUS: F.lit("paused"), REASON: F.lit("paused")})
            self._reach(step.next[0].step, self.visible[step.name])
            return df.drop("_here"), F.lit(False)
        if step.kind == "sleep":
            df = df.withColumn("_wake", S.deadline(start, F.lit(step.sleep)))
            df = df.withColumn("_go", here & (F.col("_wake") <= self.now))
            df = self._set(df, here & ~F.col("_go"), {**park, REASON: F.lit("sleeping"), WAKE: F.col("_wake")})
            return self._set(df, F.col("_go"), {CLOCK: F.col("_wake")}).drop("_here", "_wake"), F.col("_go")
        w = step.wait_signal
        if self.signals is None:
            raise InvalidDefinition([f"step {step.name!r} waits for signals, but there is no table of them"])
        topic = X.template(w.topic, self._scope(df, step))
        due = S.deadline(start, F.lit(w.timeout)) if w.timeout else F.lit(None).cast("timestamp")
        df = df.withColumns({"_topic": F.when(here, text(topic.column, topic.kind)), "_due": due})
        # a signal is used once: the oldest that no wait of the execution has used, by the order of steps and of branches
        used, k = F.col(USED), F.lit(0)
        if self.forked:
            df = df.withColumns({
                "_used": F.array_distinct(F.flatten(F.collect_list(F.col(USED)).over(self._of_execution()))),
                "_k": F.row_number().over(Window.partitionBy(KEY, "_topic").orderBy(F.col("_here").desc(), BRANCH)) - 1,
            })
            used, k = F.col("_used"), F.col("_k")
        left = F.filter(F.col("queue__"), lambda q: (q["topic"] == F.col("_topic")) & ~F.array_contains(used, q["n"]))
        df = df.withColumn("_q", F.get(left, k))
        in_time = F.col("_q.ts").isNotNull() & (F.col("_q.ts") <= F.coalesce(F.col("_due"), F.col("_q.ts"))) & (F.col("_q.ts") <= self.now)
        df = df.withColumn("_go", here & F.coalesce(in_time, F.lit(False)))
        df = df.withColumn("_late", here & ~F.col("_go") & F.coalesce(F.col("_due") <= self.now, F.lit(False)))
        got = {CLOCK: F.greatest(start, F.col("_q.ts")), USED: F.array_append(F.col(USED), F.col("_q.n"))}
        if w.store:
            got[VAR + w.store] = F.col("_q.payload")
        df = self._set(df, F.col("_go"), got)
        df = self._set(df, here & ~F.col("_go") & ~F.col("_late"), {**park, REASON: F.lit("waiting_signal"), WAKE: F.col("_due"), TOPIC: F.col("_topic")})
        if w.on_timeout:
            df = self._set(df, F.col("_late"), {AT: F.lit(w.on_timeout), CLOCK: F.col("_due")})
            self._reach(w.on_timeout, self.visible[step.name])
        elif w.timeout:
            self.fallible = True
            record = S.error_record(F.lit("timeout"), F.concat(F.lit("no signal of "), F.col("_topic")), none).cast(ERROR_TYPE)
            df = self._set(df, F.col("_late"), {**park, STATUS: F.lit("failed"), ERROR: record})
        return df.drop("_here", "_topic", "_due", "_q", "_late", "_used", "_k"), F.col("_go")

    def _kept(self, df: DataFrame, *columns: str) -> DataFrame:
        """The same rows; filters on these columns stay above, if the definition is long, or tries steps again."""
        if len(self.d.steps) <= LONG and not self.fallible:
            return df
        return df.withColumns({c: F.when(F.monotonically_increasing_id() >= 0, F.col(f"`{c}`")) for c in columns})

    def _step(self, step: Step, df: DataFrame) -> DataFrame:
        here = None if self.all_here else F.col(AT) == step.name
        only = None
        if step.kind == "join":
            df, here, only = self._join(step, df, here)
            self.all_here = False
        elif step.kind in ("pause", "sleep", "wait_signal"):
            df, here = self._wait(step, df, here)
        else:
            df = self._body(step, df, here)
            if here is None and not self.all_here:  # some have failed
                here = F.col(AT) == step.name
        left, rows = df, here
        self.steps[step.name] = lambda: left if rows is None else self._kept(left.withColumn("_at", rows), "_at").where("_at").drop("_at")
        df = self._route(step, df, here, only)
        self.all_here = self.all_here and len(step.next) == 1 and not self.forked and not (step.next[0].condition or "").strip()
        return df.drop("_go")

    # the whole

    def _next(self, name: str) -> list[str]:
        s = self.d.step(name)
        return [e.step for e in s.next] + [c.next for c in s.catch] + ([s.wait_signal.on_timeout] if s.wait_signal and s.wait_signal.on_timeout else [])

    def _cyclic(self) -> bool:
        return len(self._order()) < len(self.d.steps)

    def _begun(self, branch: str) -> set[str]:
        """The steps that a branch may come to: from the edge that begins it, along edges that begin none."""
        out: set[str] = set()
        todo = [self.d.first.name] if branch == "main" else [e.step for s in self.d.steps for e in s.next if e.branch == branch]
        while todo:
            n = todo.pop()
            if n not in out:
                out.add(n)
                named = {e.step for e in self.d.step(n).next if e.branch}
                todo += [m for m in self._next(n) if m not in named]
        return out

    def _order(self) -> list[str]:
        """Topological; of joins that are next, one whose branches can't go on, and only once nothing else is next. Steps of
        cycles, and what comes after them, are left out."""
        before: dict[str, set[str]] = {s.name: set() for s in self.d.steps}
        for s in self.d.steps:
            for m in self._next(s.name):
                before[m].add(s.name)
        out: list[str] = []
        while ready := [n for n in before if before[n] <= set(out)]:
            plain = [n for n in ready if not self.d.step(n).join]
            over = [n for n in ready if not plain and all(self._begun(b) <= set(out) for b in self.d.step(n).join.branches if b != "main")]
            n = (plain or over or ready)[0]
            out.append(n)
            del before[n]
        return out

    def _frame(self, rows: DataFrame, carry: list[str], at: Column | None = None) -> DataFrame:
        """The frame that a walk begins with: of rows with the key, inputs, and the branch's time."""
        df = rows.select(
            KEY, *carry, *(F.col(f"`{c}`") for c in rows.columns if c.startswith(IN)), F.col(CLOCK), *(F.lit(v).alias(VAR + k) for k, v in self.d.state.items()),
            *(F.lit(v in self.d.state).alias(SET + VAR + v) for v in sorted(self.tracked)), F.lit("main").alias(BRANCH), (F.lit(self.d.first.name) if at is None else at).alias(AT), *(F.lit(None).cast("string").alias(c) for c in (LAST, REASON, TOPIC)),
            F.lit("running").alias(STATUS) if at is None else F.when(at.isNotNull(), "running").otherwise("skipped").alias(STATUS), F.lit(None).cast(ERROR_TYPE).alias(ERROR), F.lit(None).cast("timestamp").alias(WAKE),
        )
        self._begin()
        self.all_here = at is None
        if self.signals is not None and any(s.wait_signal or s.activity and self._replays(s.activity) for s in self.d.steps):
            q = self.signals.select(F.col(KEY).alias("_k"), F.col("topic").cast("string").alias("topic"), F.col("ts").cast("timestamp").alias("ts"), "payload")
            q = q.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("ts", "topic", "payload"))).alias("q"))
            numbered = F.transform("q", lambda x, i: F.struct(i.alias("n"), x["ts"].alias("ts"), x["topic"].alias("topic"), x["payload"].alias("payload")))
            df = df.join(q.select("_k", numbered.alias("queue__")), F.col(KEY) == F.col("_k"), "left").drop("_k")
            df = df.withColumn(USED, F.array().cast("array<int>"))
        return df

    def _replays(self, activity: str) -> bool:
        return activity in self.registry.names() and self.registry.get(activity).replay is not None

    def _run(self, df: DataFrame) -> DataFrame:
        order = self._order()
        if len(order) < len(self.d.steps):
            return self._passes(df)
        for name in order:
            if name in self.reached:
                df = self._step(self.d.step(name), df)
        return df

    def _passes(self, df: DataFrame) -> DataFrame:
        """All steps over and over; a join only in a pass after which no other step has rows."""
        names = list(dict.fromkeys([self.d.first.name, *(m for n in self._reachable() for m in (n, *self._next(n)))]))
        plain, joins = [n for n in names if not self.d.step(n).join], [n for n in names if self.d.step(n).join]
        reached = set(self.reached)
        self.all_here = False
        for n in names:  # variables are seen wherever a cycle may bring them
            self._reach(n, set(self.d.state) | {v for m in names for s in [self.d.step(m)] for v in (s.store, *(c.store for c in s.catch), s.wait_signal.store if s.wait_signal else "") if v})
        self.reached = reached
        ended: list[DataFrame] = []
        done, at_once = 0, 1
        while True:
            for _ in range(at_once):
                if done >= self.max_rounds:
                    raise RuntimeError(f"rows are still on their way after {self.max_rounds} rounds")
                df = self._pass(plain, df)
                done += 1
            df = _checkpointed(df)
            on = df.where(F.col(AT).isin(plain)).limit(1).count() > 0
            if not on and df.where(F.col(AT).isNotNull()).limit(1).count() > 0:
                df = _checkpointed(self._pass(joins, df))
                on = df.where(F.col(AT).isNotNull()).limit(1).count() > 0
            if not on:
                return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*ended, df])
            if not joins and not any(s.wait_signal for s in self.d.steps):  # nothing looks at rows that have ended
                ended.append(df.where(F.col(AT).isNull()))
                df = df.where(F.col(AT).isNotNull())
            at_once = min(at_once * 2, max(1, min(PASSES, 48 // len(names))), max(1, self.max_rounds - done))

    def _pass(self, names: list[str], df: DataFrame) -> DataFrame:
        """Each step once. One that names a variable which no step has stored yet has no rows, and is left to the next pass,
        unless nothing is stored in this one."""
        had, error = set(df.columns), None
        for n in names:
            try:
                df = self._step(self.d.step(n), df)
            except X.CompileError as e:
                error = e
        if error and set(df.columns) <= had:
            raise error
        return df

    def _reachable(self) -> list[str]:
        out, todo = [], [self.d.first.name]
        while todo:
            n = todo.pop(0)
            if n not in out:
                out.append(n)
                todo += self._next(n)
        return out

    def compile(self, rows: DataFrame, inputs: dict[str, Any] | None = None, columns: dict[str, str] | None = None) -> Compiled:
        """rows has exec_id, and a column for each input that columns names ({input: column}); inputs are constants. A column
        entered_at says when an execution began; else it is now."""
        columns = columns or {}
        bound = self.d.bind({**(inputs or {}), **dict.fromkeys(columns, True)})
        began = F.col("entered_at").cast("timestamp") if "entered_at" in rows.columns else F.lit(None).cast("timestamp")
        df = rows.select(KEY, *(F.col(f"`{columns[k]}`").alias(IN + k) if k in columns else F.lit(v).alias(IN + k) for k, v in bound.items()), began.alias(CLOCK))
        if missing := self._unknown_outputs():
            raise InvalidDefinition(missing)
        df = self._run(self._frame(df, []))
        df = self._kept(df, STATUS, AT, *(c for c in df.columns if c.startswith(VAR)))
        return Compiled(self, df)

    def _unknown_outputs(self) -> list[str]:
        stored = set(self.d.state)
        for s in self.d.steps:
            stored |= {v for v in (s.store, *(c.store for c in s.catch), s.wait_signal.store if s.wait_signal else "") if v}
            if s.join:
                stored |= set(s.join.mappings.values()) | set(s.join.branches)
        return [f"output {o.name!r}: no branch has a variable {v!r}" for o in self.d.outputs if (v := (o.variable or o.name).split(".")[0]) not in stored]

    def _output(self, df: DataFrame, variable: str) -> Column:
        root, *path = variable.split(".")
        if VAR + root not in df.columns:
            return F.lit(None).cast("string")
        return reduce(lambda c, p: c[p], path, F.col(f"`{VAR + root}`"))

    def _executions(self, df: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """(exec_id, status, error, and the outputs) of each execution. Where executions are one row each, no shuffle."""
        carry = carry or []
        done = F.col(STATUS) == "completed"
        has = lambda o: F.col(f"`{SET}{VAR}{(o.variable or o.name).split('.')[0]}`")
        out = {f"_o{i}": F.when(done & (F.col(BRANCH) == o.branch) & has(o), F.struct(self._output(df, o.variable or o.name).alias("v"))) for i, o in enumerate(self.d.outputs)}
        df = df.select(KEY, *carry, F.coalesce(F.col(STATUS), F.lit("running")).alias("status"), F.col(ERROR).alias("error"), *(c.alias(k) for k, c in out.items()))
        if self.forked:
            rank = R.ranked(F.col("status"), R.FINAL)
            first = lambda c: F.first(c, ignorenulls=True).alias(c)
            df = df.groupBy(KEY).agg(*(first(c) for c in carry), F.max_by("status", rank).alias("status"), first("error"), *(first(c) for c in out))
        lost = [F.when(F.col(f"_o{i}").isNull(), F.lit(f"output {o.name!r}: branch {o.branch!r} has no variable {o.variable or o.name!r}")) for i, o in enumerate(self.d.outputs)]
        if lost:
            df = df.withColumn("_lost", F.when(F.col("status") == "completed", F.coalesce(*lost)))
            record = S.error_record(F.lit("activity_failed"), F.col("_lost"), F.lit(None).cast("string")).cast(ERROR_TYPE)
            df = df.withColumns({"status": F.when(F.col("_lost").isNotNull(), "failed").otherwise(F.col("status")), "error": F.when(F.col("_lost").isNotNull(), record).otherwise(F.col("error"))})
        return df.select(KEY, *carry, "status", "error", *(F.col(f"_o{i}.v").alias(o.name) for i, o in enumerate(self.d.outputs)))

    def _outputs(self, df: DataFrame, made: Compiled) -> DataFrame:
        """The outputs of the executions that have completed; without declared ones, their branches."""
        if not self.d.outputs:
            return made.branches
        if len({o.branch for o in self.d.outputs}) == 1 and not self.fallible and not any(s.kind in ("pause", "sleep", "wait_signal", "join") for s in self.d.steps):
            # all that completes can be told from one row
            rows = made.branches.where(F.col(BRANCH) == self.d.outputs[0].branch)
            roots = dict.fromkeys((o.variable or o.name).split(".")[0] for o in self.d.outputs)
            return rows.select(KEY, *(self._output(df, o.variable or o.name).alias(o.name) for o in self.d.outputs)) if all(VAR + r in df.columns for r in roots) else rows.limit(0).select(KEY, *(F.lit(None).cast("string").alias(o.name) for o in self.d.outputs))
        return made.executions.where("status = 'completed'").select(KEY, *(o.name for o in self.d.outputs))
