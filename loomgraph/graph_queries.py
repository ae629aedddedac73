"""Queries of definitions: errors, retries, handlers, waits, outputs, children, expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators.registry import builtin
from loomgraph.plans.compile import KEY, VAR, Compiler
from loomgraph.plans.spec import Definitions, from_dict
from loomgraph.queries import _inputs, _orders, query, signals, table

_R = builtin()


@_R.fallible("flaky")
def _flaky(key, attempt):
    """Fails as often as the key says, with an error of a type that depends on it too."""
    kinds = F.array(*map(F.lit, ("timeout", "fatal_error", "permission", "activity_failed")))
    ok = attempt > key % 5
    return F.concat(F.lit("ok after "), attempt.cast("string")), F.when(~ok, F.get(kinds, (key % 4).cast("int"))), F.concat(F.lit("key "), key.cast("string"))


_RETRY = from_dict({
    "name": "retry", "inputs": _inputs("key"), "outputs": [{"name": "result"}],
    "steps": [
        {"name": "try", "activity": "flaky", "parameters": {"key": "${inputs.key}"}, "store": "result",
         "retry": [{"errors": ["timeout"], "max_retries": 3}, {"errors": ["permission"], "max_retries": 1}, {"max_retries": 2}],
         "catch": [{"errors": ["timeout"], "next": "late", "store": "problem"}, {"errors": ["fatal_error"], "next": "fatal", "store": "problem"}]},
        {"name": "late", "activity": "noop", "parameters": {"value": "late: ${state.problem.Cause}"}, "store": "result"},
        {"name": "fatal", "activity": "noop", "parameters": {"value": "fatal: ${state.problem.Error}"}, "store": "result"},
    ],
})
# the first error's type picks the number of attempts; nothing but its own name meets a fatal error
_TRIED = "SELECT o_orderkey AS k, o_orderkey % 5 AS fails, o_orderkey % 4 AS m, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS more FROM orders"


def _orders_with(spark, d, definition, columns, **how):
    return Compiler(definition, _R, **how).compile(_orders(spark, d), columns=columns)


@query(f"SELECT k AS exec_id, CASE WHEN fails <= more OR m < 2 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN fails <= more OR m < 2 THEN NULL WHEN m = 2 THEN 'permission' ELSE 'activity_failed' END AS error, CASE WHEN fails <= more THEN concat('ok after ', CAST(fails + 1 AS VARCHAR)) WHEN m = 0 THEN concat('late: key ', CAST(k AS VARCHAR)) WHEN m = 1 THEN 'fatal: fatal_error' END AS result FROM ({_TRIED})")
def retry_rows(spark, d):
    return _orders_with(spark, d, _RETRY, {"key": "o_orderkey"}).executions.select(KEY, "status", F.col("error.Error").alias("error"), "result")


@query(f"SELECT k AS exec_id, CASE WHEN m = 0 THEN 'late' ELSE 'fatal' END AS at_step, CASE WHEN m = 0 THEN 'timeout' ELSE 'fatal_error' END AS error, concat('key ', CAST(k AS VARCHAR)) AS cause FROM ({_TRIED}) WHERE fails > more AND m < 2")
def catch_route(spark, d):
    b = _orders_with(spark, d, _RETRY, {"key": "o_orderkey"}).branches.where("at_step <> 'try'")
    return b.select(KEY, "at_step", F.col(VAR + "problem.Error").alias("error"), F.col(VAR + "problem.Cause").alias("cause"))


@query(f"SELECT k AS exec_id, 'try' AS at_step, CASE WHEN m = 2 THEN 'permission' ELSE 'activity_failed' END AS error FROM ({_TRIED}) WHERE fails > more AND m >= 2")
def failed_branches(spark, d):
    return _orders_with(spark, d, _RETRY, {"key": "o_orderkey"}).failed.select(KEY, "at_step", F.col("error.Error").alias("error"))


@query("WITH f AS (SELECT o_orderkey AS exec_id, o_totalprice > 200000 AS bad FROM orders) SELECT exec_id, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN NULL ELSE 'kept' END AS other FROM f")
def fail_fast(spark, d):
    """A branch that fails fails its execution, whatever the others do."""
    d_ = from_dict({"name": "ff", "inputs": _inputs("price"), "outputs": [{"name": "other", "branch": "b"}], "steps": [
        {"name": "s", "next": [{"step": "x", "branch": "a"}, {"step": "y", "branch": "b"}]},
        {"name": "x", "edge_matching": "first", "next": [{"step": "boom", "condition": "inputs.price > 200000"}]},
        {"name": "boom", "activity": "fail", "parameters": {"message": "too dear"}},
        {"name": "y", "activity": "noop", "parameters": {"value": "kept"}, "store": "other"}]})
    e = _orders_with(spark, d, d_, {"price": "o_totalprice"}).executions
    return e.select(KEY, "status", F.when(F.col("status") == "completed", F.col("other")).alias("other"))


_WAIT_TWICE = from_dict({
    "name": "two", "outputs": [{"name": "one"}, {"name": "two"}],
    "steps": [{"name": "first", "wait_signal": {"topic": "t", "store": "one"}, "next": [{"step": "second"}]}, {"name": "second", "wait_signal": {"topic": "t", "store": "two"}}],
})
_QUEUE = "WITH q AS (SELECT user_id AS u, value AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS r FROM events WHERE event_type = 'purchase'), u AS (SELECT DISTINCT user_id AS u FROM events) "


def _users(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias(KEY)).agg(F.lit(None).cast("timestamp").alias("entered_at"))


@query(_QUEUE + "SELECT u AS exec_id, CASE WHEN b.payload IS NULL THEN 'suspended' ELSE 'completed' END AS status, CASE WHEN b.payload IS NULL THEN NULL ELSE a.payload END AS one, b.payload AS two FROM u LEFT JOIN (SELECT * FROM q WHERE r = 1) a USING (u) LEFT JOIN (SELECT * FROM q WHERE r = 2) b USING (u)")
def two_waits(spark, d):
    """Each signal is used once: two waits get the oldest two."""
    c = Compiler(_WAIT_TWICE, _R, signals=signals(spark, d)).compile(_users(spark, d))
    return c.executions.select(KEY, "status", "one", "two")


@_R.replayed("collect_two", "double")
def _collect_two(context, plus):
    return context.wait("t") + context.wait("t") + plus


@query(_QUEUE + "SELECT u AS exec_id, CASE WHEN b.payload IS NULL THEN 'suspended' ELSE 'completed' END AS status, CASE WHEN b.payload IS NOT NULL THEN round(a.payload + b.payload + 1, 6) END AS total FROM u LEFT JOIN (SELECT * FROM q WHERE r = 1) a USING (u) LEFT JOIN (SELECT * FROM q WHERE r = 2) b USING (u)")
def waits_in_activity(spark, d):
    """An activity that waits twice while it runs."""
    d_ = from_dict({"name": "w", "outputs": [{"name": "total"}], "steps": [{"name": "s", "activity": "collect_two", "parameters": {"plus": 1}, "store": "total"}]})
    e = Compiler(d_, _R, signals=signals(spark, d)).compile(_users(spark, d)).executions
    return e.select(KEY, "status", F.round("total", 6).alias("total"))


@query(_QUEUE + "SELECT u AS exec_id, 'a' AS branch_id, payload FROM u JOIN q USING (u) WHERE r = 1 UNION ALL SELECT u, 'b', payload FROM u JOIN q USING (u) WHERE r = 2")
def waits_of_branches(spark, d):
    """Branches that wait for one topic share its signals, in the order of their names."""
    d_ = from_dict({"name": "w", "steps": [{"name": "s", "next": [{"step": "wait", "branch": "a"}, {"step": "wait", "branch": "b"}]}, {"name": "wait", "wait_signal": {"topic": "t", "store": "got"}}]})
    c = Compiler(d_, _R, signals=signals(spark, d)).compile(_users(spark, d))
    return c.branches.where("at_step = 'wait'").select(KEY, "branch_id", F.col(VAR + "got").alias("payload"))


@query("WITH e AS (SELECT user_id AS u, min(ts) AS began FROM events GROUP BY user_id), q AS (SELECT user_id AS u, min(ts) AS came FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT u AS exec_id, CASE WHEN came <= began + INTERVAL 90 MINUTE THEN 'completed' ELSE 'failed' END AS status, CASE WHEN came <= began + INTERVAL 90 MINUTE THEN NULL ELSE 'timeout' END AS error FROM e LEFT JOIN q USING (u)")
def wait_fails(spark, d):
    """A wait that is over, and leads nowhere, fails as a time-out."""
    d_ = from_dict({"name": "w", "steps": [{"name": "w", "wait_signal": {"topic": "t", "timeout": 5400, "store": "got"}}]})
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias(KEY)).agg(F.min("ts").alias("entered_at"))
    return Compiler(d_, _R, signals=signals(spark, d)).compile(rows).executions.select(KEY, "status", F.col("error.Error").alias("error"))


@query("SELECT event_id AS exec_id, CASE WHEN ts + INTERVAL 2500 MILLISECOND <= TIMESTAMP '2024-01-15 00:00:00' THEN 'completed' ELSE 'suspended' END AS status FROM events")
def sleep_steps(spark, d):
    d_ = from_dict({"name": "n", "steps": [{"name": "nap", "sleep": 2.5}]})
    rows = table(spark, d, "events").select(F.col("event_id").alias(KEY), F.col("ts").alias("entered_at"))
    now = F.expr("TIMESTAMP '2024-01-15 00:00:00'")
    c = Compiler(d_, _R)
    c.now = now
    return c.compile(rows).executions.select(KEY, "status")


@query("SELECT o_orderkey AS exec_id, CASE WHEN o_totalprice > 100000 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN o_totalprice > 100000 THEN 'high' END AS band FROM orders")
def output_missing(spark, d):
    """An execution that ends without a declared output has failed, and is there all the same."""
    d_ = from_dict({"name": "o", "inputs": _inputs("price"), "outputs": [{"name": "band"}], "steps": [
        {"name": "s", "edge_matching": "first", "next": [{"step": "high", "condition": "inputs.price > 100000"}]}, {"name": "high", "activity": "noop", "parameters": {"value": "high"}, "store": "band"}]})
    return _orders_with(spark, d, d_, {"price": "o_totalprice"}).executions.select(KEY, "status", "band")


@query("SELECT o_orderkey AS exec_id, o_orderkey % 3 <> 0 AS success, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN concat('child of ', CAST(o_orderkey AS VARCHAR)) END AS said FROM orders")
def child_outcome(spark, d):
    """A child's failure is told to its parent, which goes on."""
    known = Definitions()
    known.register(from_dict({"name": "inner", "inputs": _inputs("k"), "outputs": [{"name": "said"}], "steps": [
        {"name": "s", "edge_matching": "first", "next": [{"step": "no", "condition": "inputs.k % 3 == 0"}, {"step": "yes"}]}, {"name": "no", "activity": "fail"}, {"name": "yes", "activity": "noop", "parameters": {"value": "child of ${inputs.k}"}, "store": "said"}]}))
    d_ = from_dict({"name": "outer", "inputs": _inputs("k"), "outputs": [{"name": "r"}], "steps": [{"name": "c", "activity": "child", "parameters": {"definition": "inner", "inputs": {"k": "${inputs.k}"}}, "store": "r"}]})
    out = _orders_with(spark, d, d_, {"k": "o_orderkey"}, definitions=known).outputs
    return out.select(KEY, "r.success", "r.status", F.col("r.outputs.said").alias("said"))


@query("SELECT o_orderkey AS exec_id, (o_totalprice >= 100000 AND o_orderkey % 2 = 0) OR NOT (o_orderstatus <> 'F') AS both, o_totalprice <= 50000 OR o_orderstatus = 'O' AS either FROM orders")
def logical_operators(spark, d):
    d_ = from_dict({"name": "l", "inputs": _inputs("p", "k", "s"), "outputs": [{"name": "both"}, {"name": "either"}], "steps": [
        {"name": "a", "activity": "noop", "parameters": {"v": '${(inputs.p >= 100000 && inputs.k % 2 == 0) || !(inputs.s != "F")}'}, "store": "both", "next": [{"step": "b"}]},
        {"name": "b", "activity": "noop", "parameters": {"v": '${inputs.p <= 50000 || inputs.s == "O"}'}, "store": "either"}]})
    return _orders_with(spark, d, d_, {"p": "o_totalprice", "k": "o_orderkey", "s": "o_orderstatus"}).outputs


@query("SELECT o_orderkey AS exec_id, o_orderkey AS k, 7 AS seven, 'x' AS given FROM orders")
def input_binding(spark, d):
    d_ = from_dict({"name": "i", "inputs": [{"name": "k"}, {"name": "seven", "default": 7}, {"name": "given", "default": "y"}], "outputs": [{"name": n} for n in ("k", "seven", "given")], "steps": [
        {"name": "a", "activity": "noop", "parameters": {"v": "${inputs.k}"}, "store": "k", "next": [{"step": "b"}]}, {"name": "b", "activity": "noop", "parameters": {"v": "${inputs.seven}"}, "store": "seven", "next": [{"step": "c"}]},
        {"name": "c", "activity": "noop", "parameters": {"v": "${inputs.given}"}, "store": "given"}]})
    return Compiler(d_, _R).compile(_orders(spark, d), inputs={"given": "x"}, columns={"k": "o_orderkey"}).outputs


@query("SELECT o_orderkey AS exec_id, o_totalprice > 100000 AND o_orderkey % 2 = 0 AS on_time FROM orders")
def engine_swapped(spark, d):
    """Expressions in SQL, by another engine: inputs and state are columns there."""
    from loomgraph.functions.expressions import Value

    def sql(code, scope):
        names = {f"inputs.{k}": v for k, v in scope.inputs.items()} | {f"state.{k}": v for k, v in scope.state.items()}
        for k, v in names.items():
            code = code.replace(k, f"`{v}`")
        return Value(F.expr(code), scope.df.select(F.expr(code).alias("x")).schema["x"].dataType)

    d_ = from_dict({"name": "e", "inputs": _inputs("p", "k"), "outputs": [{"name": "on_time"}], "steps": [{"name": "a", "activity": "noop", "parameters": {"v": "${inputs.p > 100000 AND inputs.k % 2 = 0}"}, "store": "on_time"}]})
    return _orders_with(spark, d, d_, {"p": "o_totalprice", "k": "o_orderkey"}, engine=sql).outputs


@query("SELECT o_orderkey AS exec_id, concat('order ', CAST(o_orderkey AS VARCHAR), ' (', o_orderstatus, ')') AS line FROM orders")
def print_form(spark, d):
    d_ = from_dict({"name": "p", "inputs": _inputs("k", "s"), "outputs": [{"name": "line"}], "steps": [{"name": "a", "activity": "print", "parameters": {"message": "order %d (%v)", "args": ["${inputs.k}", "${inputs.s}"]}, "store": "line"}]})
    return _orders_with(spark, d, d_, {"k": "o_orderkey", "s": "o_orderstatus"}).outputs


@query("SELECT event_id AS exec_id, json_extract_string(props, '$.k') AS k FROM events")
def json_parse_step(spark, d):
    d_ = from_dict({"name": "j", "inputs": _inputs("props"), "outputs": [{"name": "k"}], "steps": [
        {"name": "a", "activity": "json", "parameters": {"operation": "parse", "data": "${inputs.props}"}, "store": "doc", "next": [{"step": "b"}]}, {"name": "b", "activity": "noop", "parameters": {"v": "${state.doc.k}"}, "store": "k"}]})
    rows = table(spark, d, "events").withColumn(KEY, F.col("event_id"))
    return Compiler(d_, _R).compile(rows, columns={"props": "props"}).outputs.select(KEY, F.col("k").cast("string").alias("k"))


@query("SELECT o_orderkey AS exec_id, CASE WHEN o_totalprice > 100000 THEN 'dear' ELSE 'cheap' END AS band, o_orderkey * 3 AS total FROM orders")
def post_join_route(spark, d):
    """After a join, edges see the merged variables."""
    d_ = from_dict({"name": "pj", "inputs": _inputs("price", "k"), "outputs": [{"name": "band", "branch": "final"}, {"name": "total", "branch": "final"}], "steps": [
        {"name": "s", "next": [{"step": "a", "branch": "a"}, {"step": "b", "branch": "b"}, {"step": "m", "branch": "final"}]},
        {"name": "a", "activity": "noop", "parameters": {"v": "${inputs.price}"}, "store": "p"}, {"name": "b", "activity": "noop", "parameters": {"v": "${inputs.k * 3}"}, "store": "n"},
        {"name": "m", "join": {"branches": ["a", "b"], "mappings": {"a.p": "price", "b.n": "total"}}, "edge_matching": "first", "next": [{"step": "dear", "condition": "state.price > 100000"}, {"step": "cheap"}]},
        *({"name": n, "activity": "noop", "parameters": {"v": n}, "store": "band"} for n in ("dear", "cheap"))]})
    return _orders_with(spark, d, d_, {"price": "o_totalprice", "k": "o_orderkey"}).outputs


@query("SELECT event_id AS id, 'signal' AS kind FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'sleep' FROM events WHERE event_type <> 'view'")
def wait_kinds(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), S.checked(F.when(F.col("event_type") == "view", "signal").otherwise("sleep"), ["signal", "sleep"], "kind of wait").alias("kind"))


@query("SELECT o_orderkey AS id, o_orderstatus AS a_b, o_orderkey AS a_c_d, o_custkey AS x FROM orders")
def nested_write(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.struct(F.struct(F.col("o_orderstatus").alias("b"), F.lit(1).alias("c")).alias("a"), F.col("o_custkey").alias("x")).alias("v"))
    out = S.with_path(F.col("v"), o.schema["v"].dataType, "a.c.d", F.col("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), out.alias("v")).select("id", F.col("v.a.b").alias("a_b"), F.col("v.a.c.d").alias("a_c_d"), F.col("v.x").alias("x"))
