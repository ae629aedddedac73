"""The library's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.functions.truth import truthy
from loomgraph.operators import runs as R
from loomgraph.operators.registry import Registry
from loomgraph.plans.compile import KEY, VAR, Compiler
from loomgraph.plans.spec import Definition, Definitions, from_dict
from loomgraph.sources import generated as G
from loomgraph.streaming.durable import due

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = "TIMESTAMP_NTZ '1998-06-01 00:00:00'"
NOW_SQL = "TIMESTAMP '1998-06-01 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# The history of runs, derived from orders and events.

_RUNS = """
SELECT k, concat('run-', CAST(k AS {s})) AS id,
  CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'queued' WHEN k % 2 = 0 THEN 'running' ELSE 'completed' END AS status,
  CAST(k % 4 AS INT) AS attempt,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('org-', CAST(o_custkey % 5 AS {s})) END AS org_id,
  o_orderpriority AS definition_type, CAST(k % 3 * 5 AS INT) AS credit_cost, concat('v', CAST(k % 6 AS {s})) AS tag,
  CASE WHEN k % 7 = 0 THEN NULL ELSE concat('run-', CAST(k - k % 7 AS {s})) END AS parent_run_id,
  concat('worker-', CAST(k % 3 AS {s})) AS claimed_by, o_orderdate AS created_at, o_orderdate AS heartbeat_at,
  CASE WHEN o_orderstatus = 'F' AND k % 10 <> 0 THEN o_orderdate + INTERVAL {day} ELSE NULL END AS completed_at
FROM (SELECT *, o_orderkey AS k FROM orders)
"""
_LEDGER = """
SELECT id AS run_id, org_id, credit_cost AS amount, 'debit' AS reason FROM runs WHERE credit_cost > 0 AND k % 4 <> 0
UNION ALL
SELECT id, org_id, -credit_cost, 'refund' FROM runs WHERE credit_cost > 0 AND k % 4 <> 0 AND status = 'failed' AND k % 7 = 0
"""
_WITH = f"WITH runs AS ({_RUNS.format(s='VARCHAR', day='1 DAY')}), ledger AS ({_LEDGER}) "
_WAITS = "WITH signals AS (SELECT user_id AS exec_id, 't' AS topic, value AS payload, ts, event_id AS seq FROM events WHERE event_type = 'purchase'), waits AS (SELECT user_id AS exec_id, 't' AS topic, ts AS start, ts + INTERVAL 1 HOUR AS wake_at, event_id AS seq FROM events WHERE event_type = 'view') "


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return spark.sql(_RUNS.format(s="STRING", day="'1' DAY").replace("FROM orders", "FROM {orders}"), orders=o)


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_LEDGER.replace("FROM runs", "FROM {runs}"), runs=runs(spark, d))


def signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").selectExpr("user_id AS exec_id", "'t' AS topic", "value AS payload", "ts", "event_id AS seq")


def waits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'view'").selectExpr("user_id AS exec_id", "'t' AS topic", "ts AS start", "ts + INTERVAL '1' HOUR AS wake_at", "event_id AS seq")


_REGISTRY = Registry()


@_REGISTRY.function("label")
def _label(value):
    return value


@_REGISTRY.function("scale")
def _scale(value, by):
    return (value * by).cast("bigint")


@_REGISTRY.function("add")
def _add(left, right):
    return left + right


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn(KEY, F.col("o_orderkey"))


def _compiled(spark: SparkSession, d: str, definition: Definition, columns: dict[str, str], inputs: dict | None = None):
    return Compiler(definition, _REGISTRY).compile(_orders(spark, d), inputs, columns)


def _inputs(*names: str) -> list[dict]:
    return [{"name": n} for n in names]


def _labels(*steps: tuple[str, str]) -> list[dict]:
    return [{"name": n, "activity": "label", "parameters": {"value": v}, "store": "band"} for n, v in steps]


_ROUTE = from_dict({
    "name": "route", "inputs": _inputs("price"), "outputs": [{"name": "band"}],
    "steps": [
        {"name": "load", "activity": "label", "parameters": {"value": "${inputs.price}"}, "store": "price", "edge_matching": "first",
         "next": [{"step": "high", "condition": "state.price > 200000"}, {"step": "mid", "condition": "state.price > 100000"}, {"step": "low"}]},
        *_labels(("high", "high"), ("mid", "mid"), ("low", "low")),
    ],
})


@query("SELECT o_orderkey AS exec_id, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def route_first(spark, d):
    return _compiled(spark, d, _ROUTE, {"price": "o_totalprice"}).outputs


_ALL = from_dict({
    "name": "all", "inputs": _inputs("price"),
    "steps": [
        {"name": "load", "activity": "label", "parameters": {"value": "${inputs.price}"}, "store": "price",
         "next": [{"step": "a", "condition": "state.price > 100000"}, {"step": "b", "condition": "state.price < 200000"}, {"step": "c", "condition": "state.price > 300000"}]},
        *_labels(("a", "over 100000"), ("b", "under 200000"), ("c", "over 300000")),
    ],
})


@query("SELECT o_orderkey AS exec_id, 'a' AS at_step, 'over 100000' AS band FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_orderkey, 'b', 'under 200000' FROM orders WHERE o_totalprice < 200000 UNION ALL SELECT o_orderkey, 'c', 'over 300000' FROM orders WHERE o_totalprice > 300000")
def route_all(spark, d):
    ended = _compiled(spark, d, _ALL, {"price": "o_totalprice"}).branches
    return ended.where("at_step <> 'load'").select(KEY, "at_step", F.col(VAR + "band").alias("band"))


@query("SELECT o_orderkey AS exec_id, 'taken' AS band FROM orders")
def route_literal(spark, d):
    d_ = from_dict({"name": "literal", "inputs": _inputs("key"), "steps": [{"name": "s", "activity": "label", "parameters": {"value": "${inputs.key}"}, "store": "k", "next": [{"step": "yes", "condition": " TRUE "}, {"step": "no", "condition": "false"}]}, *_labels(("yes", "taken"), ("no", "never"))]})
    return _compiled(spark, d, d_, {"key": "o_orderkey"}).branches.where("s__band IS NOT NULL").select(KEY, F.col(VAR + "band").alias("band"))


@query("SELECT event_id, value <> 0 AS of_number, event_type <> '' AND lower(event_type) <> 'false' AS of_text, user_id % 2 <> 0 AS of_integer, FALSE AS of_null, event_type = 'view' AS of_boolean, TRUE AS of_list FROM events")
def truthy_by_type(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "value", "event_type", "user_id % 2 AS odd", "event_type = 'view' AS is_view", "array(event_id) AS ids")
    kind = lambda c: e.schema[c].dataType
    return e.select("event_id", *(truthy(F.col(c), kind(c)).alias(a) for c, a in (("value", "of_number"), ("event_type", "of_text"), ("odd", "of_integer"), ("is_view", "of_boolean"), ("ids", "of_list"))), F.lit(False).alias("of_null"))


def _one(name: str, value, *inputs: str) -> Definition:
    return from_dict({"name": name, "inputs": _inputs(*inputs), "outputs": [{"name": "result"}], "steps": [{"name": "s", "activity": "label", "parameters": {"value": value}, "store": "result"}]})


@query("SELECT o_orderkey AS exec_id, concat('order ', CAST(o_orderkey AS VARCHAR), ' is ', o_orderstatus, '/', CAST(o_orderkey * 2 AS VARCHAR)) AS result FROM orders")
def template_interp(spark, d):
    return _compiled(spark, d, _one("t", "order ${inputs.key} is ${inputs.status}/${inputs.key * 2}", "key", "status"), {"key": "o_orderkey", "status": "o_orderstatus"}).outputs


@query("SELECT o_orderkey AS exec_id, o_orderkey * 2 + 1 AS result FROM orders")
def template_single(spark, d):
    return _compiled(spark, d, _one("t", " ${inputs.key * 2 + 1} ", "key"), {"key": "o_orderkey"}).outputs


@query("SELECT o_orderkey AS exec_id, o_orderkey AS a, concat('c', CAST(o_custkey AS VARCHAR)) AS b, 'x' AS c FROM orders")
def params_struct(spark, d):
    out = _compiled(spark, d, _one("p", {"a": "${inputs.key}", "in": {"b": "c${inputs.cust}", "c": "x"}}, "key", "cust"), {"key": "o_orderkey", "cust": "o_custkey"}).outputs
    return out.select(KEY, "result.a", "result.in.b", "result.in.c")


@query("SELECT o_orderkey AS exec_id, o_custkey AS customer, o_orderstatus AS status FROM orders")
def output_projection(spark, d):
    d_ = from_dict({"name": "o", "inputs": _inputs("cust", "status"), "outputs": [{"name": "customer", "variable": "all.cust"}, {"name": "status"}], "steps": [
        {"name": "a", "activity": "label", "parameters": {"value": {"cust": "${inputs.cust}"}}, "store": "all", "next": [{"step": "b"}]},
        {"name": "b", "activity": "label", "parameters": {"value": "${inputs.status}"}, "store": "status"}]})
    return _compiled(spark, d, d_, {"cust": "o_custkey", "status": "o_orderstatus"}).outputs


_JOIN = from_dict({
    "name": "join", "inputs": _inputs("key"), "outputs": [{"name": "total", "branch": "final"}, {"name": "doubled", "branch": "final"}, {"name": "tripled", "branch": "final"}],
    "steps": [
        {"name": "setup", "activity": "label", "parameters": {"value": "${inputs.key}"}, "store": "start",
         "next": [{"step": "double", "branch": "a"}, {"step": "triple", "branch": "b"}, {"step": "meet", "branch": "final"}]},
        {"name": "double", "activity": "scale", "parameters": {"value": "${state.start}", "by": 2}, "store": "result"},
        {"name": "triple", "activity": "scale", "parameters": {"value": "${state.start}", "by": 3}, "store": "result"},
        {"name": "meet", "join": {"branches": ["a", "b"], "mappings": {"a.result": "doubled", "b.result": "tripled"}}, "next": [{"step": "sum"}]},
        {"name": "sum", "activity": "add", "parameters": {"left": "${state.doubled}", "right": "${state.tripled}"}, "store": "total"},
    ],
})


@query("SELECT o_orderkey AS exec_id, o_orderkey * 5 AS total, o_orderkey * 2 AS doubled, o_orderkey * 3 AS tripled FROM orders")
def branch_join_named(spark, d):
    return _compiled(spark, d, _JOIN, {"key": "o_orderkey"}).outputs


def _meeting(**join) -> Definition:
    """Branches a and b are begun by price; final waits for branches, of which the one that began them is one."""
    return from_dict({
        "name": "meeting", "inputs": _inputs("price"), "outputs": [{"name": "price", "branch": "final"}],
        "steps": [
            {"name": "setup", "activity": "label", "parameters": {"value": "${inputs.price}"}, "store": "price",
             "next": [{"step": "over", "branch": "a", "condition": "state.price > 100000"}, {"step": "under", "branch": "b", "condition": "state.price > 50000"}, {"step": "meet", "branch": "final"}]},
            *_labels(("over", "a"), ("under", "b")),
            {"name": "meet", "join": join},
        ],
    })


@query("SELECT o_orderkey AS exec_id, o_totalprice AS price FROM orders WHERE o_totalprice > 100000")
def branch_join_count(spark, d):
    return _compiled(spark, d, _meeting(count=3), {"price": "o_totalprice"}).outputs


@query("SELECT o_orderkey AS exec_id, o_totalprice AS price FROM orders WHERE o_totalprice > 50000")
def branch_join_default(spark, d):
    return _compiled(spark, d, _meeting(mappings={"a": "a"}), {"price": "o_totalprice"}).outputs


@query("SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linestatus = 'F') >= 2")
def completed_branches(spark, d):
    return R.ready_by_count(table(spark, d, "lineitem"), "l_orderkey", completed=F.col("l_linestatus") == "F")


@query("SELECT c_custkey AS exec_id, c_custkey * 6 + 1 AS result FROM customer")
def sub_pipeline(spark, d):
    inner = from_dict({"name": "inner", "inputs": _inputs("n"), "outputs": [{"name": "result"}], "steps": [{"name": "s", "activity": "scale", "parameters": {"value": "${inputs.n}", "by": 6}, "store": "result"}]})
    outer = from_dict({"name": "outer", "inputs": _inputs("n"), "outputs": [{"name": "result"}], "steps": [
        {"name": "run", "activity": "child", "parameters": {"definition": "inner", "inputs": {"n": "${inputs.n}"}}, "store": "r", "next": [{"step": "s"}]},
        {"name": "s", "activity": "label", "parameters": {"value": "${state.r.outputs.result + 1}"}, "store": "result"}]})
    known = Definitions()
    known.register(inner)
    return Compiler(outer, _REGISTRY, definitions=known).compile(table(spark, d, "customer").withColumn(KEY, F.col("c_custkey")), columns={"n": "c_custkey"}).outputs


@query("SELECT doc_id, CAST(len([x FOR x IN string_split(text, ' ') IF x <> '']) AS INT) AS n, [lower(x) FOR x IN string_split(text, ' ') IF x <> ''][1] AS first FROM documents")
def each_array(spark, d):
    r = Registry()
    r.function("lower")(lambda word: F.lower(word))
    d_ = from_dict({"name": "each", "inputs": _inputs("words"), "outputs": [{"name": "out"}], "steps": [{"name": "s", "activity": "lower", "parameters": {"word": "${state.word}"}, "each": {"items": "${inputs.words}", "as": "word"}, "store": "out"}]})
    docs = table(spark, d, "documents").select(F.col("doc_id").alias(KEY), F.filter(F.split("text", " "), lambda w: w != "").alias("words"))
    return Compiler(d_, r).compile(docs, columns={"words": "words"}).outputs.select(F.col(KEY).alias("doc_id"), F.size("out").alias("n"), F.try_element_at("out", F.lit(1)).alias("first"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def each_map(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    items = e.select("event_id", F.explode(S.each_value(F.col("m"), e.schema["m"].dataType)).alias("x"))
    return items.select("event_id", "x.key", "x.value")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_query(spark, d):
    return table(spark, d, "events").select("event_id", S.json_query(F.col("props"), "k").alias("k"))


@query("SELECT event_id AS id, json_valid(props) AS valid FROM events UNION ALL SELECT doc_id, json_valid(text) FROM documents")
def json_validate(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), S.json_validate("props").alias("valid"))
    return e.unionByName(table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.json_validate("text").alias("valid")))


@query("SELECT event_id, json_extract_string(json_merge_patch(props, '{\"extra\": \"x\"}'), '$.k') AS k, json_extract_string(json_merge_patch(props, '{\"extra\": \"x\"}'), '$.extra') AS extra FROM events")
def json_merge(spark, d):
    m = table(spark, d, "events").select("event_id", S.json_merge(F.col("props"), F.lit('{"extra": "x"}')).alias("m"))
    return m.select("event_id", S.json_query(F.col("m"), "k").alias("k"), S.json_query(F.col("m"), "extra").alias("extra"))


@query("SELECT o_orderkey, n, CAST(least(power(2, n - 1), 30) AS BIGINT) AS delay FROM orders, (SELECT unnest(range(1, 9)) AS n)")
def backoff_schedule(spark, d):
    tries = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"))
    return tries.select("o_orderkey", F.col("n").cast("bigint").alias("n"), S.backoff(F.col("n"), cap=30).cast("bigint").alias("delay"))


_KINDS = "CASE k % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'fatal_error' WHEN 2 THEN 'permission' ELSE 'activity_failed' END"


@query(_WITH + f"SELECT id, kind, pattern, CASE WHEN kind = 'fatal_error' THEN pattern = 'fatal_error' WHEN pattern = 'all' THEN TRUE WHEN pattern = 'activity_failed' THEN kind <> 'timeout' ELSE kind = pattern END AS hit FROM (SELECT id, {_KINDS} AS kind FROM runs), (SELECT unnest(['all', 'activity_failed', 'timeout', 'fatal_error', 'permission']) AS pattern)")
def error_match(spark, d):
    r = runs(spark, d).selectExpr("id", f"{_KINDS} AS kind", "explode(array('all', 'activity_failed', 'timeout', 'fatal_error', 'permission')) AS pattern")
    return r.withColumn("hit", S.matches_error(F.col("kind"), F.col("pattern")))


@query(_WITH + f"SELECT id, kind, CASE kind WHEN 'timeout' THEN 0 WHEN 'permission' THEN 1 WHEN 'fatal_error' THEN NULL ELSE 2 END AS policy FROM (SELECT id, {_KINDS} AS kind FROM runs)")
def retry_policy(spark, d):
    return runs(spark, d).selectExpr("id", f"{_KINDS} AS kind").withColumn("policy", S.first_policy(F.col("kind"), [["timeout"], ["permission"], []]))


_SEEN = "id, status, definition_type, created_at"


@query(_WITH + f"SELECT {_SEEN} FROM runs WHERE id = 'run-101' AND org_id IS NOT DISTINCT FROM (SELECT org_id FROM runs WHERE k = 101)")
def run_get(spark, d):
    r = runs(spark, d)
    org = r.where("k = 101").select("org_id").first()
    return R.get(r, (org and org["org_id"]) or "", "run-101").select(*_SEEN.split(", "))


@query(_WITH + f"SELECT {_SEEN} FROM runs WHERE org_id = 'org-1' AND (created_at, id) < (TIMESTAMP '1998-01-01 00:00:00', 'run-5') ORDER BY created_at DESC, id DESC LIMIT 51")
def run_list_page(spark, d):
    f = R.RunFilter(cursor=(_ntz("1998-01-01 00:00:00"), "run-5"))
    return R.page(runs(spark, d), "org-1", f).select(*_SEEN.split(", "))


def _ntz(s: str):
    return F.expr(f"TIMESTAMP_NTZ '{s}'")


@query(_WITH + f"SELECT {_SEEN} FROM runs WHERE org_id IS NULL AND status = 'queued' AND definition_type = '1-URGENT' AND tag = 'v1'")
def run_list_filters(spark, d):
    f = R.RunFilter(status="queued", definition_type="1-URGENT", metadata={"tag": "v1"})
    r = runs(spark, d).withColumn("metadata", F.create_map(F.lit("tag"), F.col("tag")))
    return r.where(R.where("", f)).select(*_SEEN.split(", "))


@query(_WITH + "SELECT count(*) AS n FROM runs WHERE org_id = 'org-2' AND status = 'failed'")
def run_count(spark, d):
    return R.count(runs(spark, d), "org-2", R.RunFilter(status="failed"))


@query(_WITH + f"SELECT {_SEEN} FROM runs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1")
def claim_top1(spark, d):
    return R.claimable(runs(spark, d)).select(*_SEEN.split(", "))


@query(_WITH + ", c AS (SELECT id FROM runs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1) SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'running' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM c) THEN attempt + 1 ELSE attempt END AS attempt, CASE WHEN id IN (SELECT id FROM c) THEN 'w' ELSE claimed_by END AS claimed_by FROM runs")
def claim_post_state(spark, d):
    r = runs(spark, d).withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    return R.claim(r, "w", F.expr(NOW)).select("id", "status", "attempt", "claimed_by")


_LEASE = "claimed_by = 'worker-1' AND attempt = 1"


@query(_WITH + f"SELECT id, CASE WHEN {_LEASE} THEN 'completed' ELSE status END AS status, CASE WHEN {_LEASE} THEN {NOW_SQL} ELSE completed_at END AS completed_at FROM runs")
def complete_post_state(spark, d):
    r = runs(spark, d).withColumn("error_message", F.lit(""))
    return R.complete(r, F.expr(_LEASE), "completed", F.expr(NOW)).select("id", "status", "completed_at")


_STALE = f"status = 'running' AND heartbeat_at < {NOW_SQL} AND id NOT IN ('run-2', 'run-4')"


@query(_WITH + f"SELECT id, CASE WHEN {_STALE} AND attempt < 3 THEN 'queued' ELSE status END AS status, CASE WHEN {_STALE} AND attempt < 3 THEN '' ELSE claimed_by END AS claimed_by FROM runs")
def reclaim_post_state(spark, d):
    return R.reclaim(runs(spark, d), F.expr(NOW), 3, ["run-2", "run-4"]).select("id", "status", "claimed_by")


@query(_WITH + f"SELECT id, org_id, definition_type, credit_cost FROM runs WHERE {_STALE} AND attempt >= 2")
def dead_letter(spark, d):
    return R.dead_letters(runs(spark, d), F.expr(NOW), 2, ["run-2", "run-4"]).select("id", "org_id", "definition_type", "credit_cost")


@query(_WITH + f"SELECT count(*) FILTER ({_STALE} AND attempt < 3) AS n FROM runs")
def reclaim_count(spark, d):
    return R.affected(runs(spark, d), R.stale(F.expr(NOW), ["run-2", "run-4"]) & (F.col("attempt") < 3))


@query(_WITH + "SELECT id, status FROM runs WHERE NOT coalesce(id = 'run-7' AND org_id = 'org-1' AND status <> 'running', FALSE)")
def delete_guard(spark, d):
    return R.delete(runs(spark, d), "org-1", "run-7").select("id", "status")


@query(_WITH + "SELECT id, status, attempt FROM runs UNION ALL SELECT concat('run-', CAST(c_custkey * 50 AS VARCHAR)), 'queued', 0 FROM customer WHERE concat('run-', CAST(c_custkey * 50 AS VARCHAR)) NOT IN (SELECT id FROM runs)")
def enqueue_dedupe(spark, d):
    new = table(spark, d, "customer").selectExpr("concat('run-', CAST(c_custkey * 50 AS STRING)) AS id")
    return R.enqueue(runs(spark, d).select("id", "status", "attempt"), new.unionByName(new), skip=True)


@query(_WITH + "SELECT r.id, r.org_id, r.credit_cost FROM runs r JOIN ledger l ON l.run_id = r.id AND l.reason = 'debit' WHERE r.status = 'failed' AND r.credit_cost > 0 AND NOT EXISTS (SELECT 1 FROM ledger x WHERE x.run_id = r.id AND x.reason = 'refund') ORDER BY r.completed_at NULLS LAST, r.id LIMIT 50")
def refund_pending(spark, d):
    return R.refund_pending(runs(spark, d), ledger(spark, d), 50).select("id", "org_id", "credit_cost")


@query(_WITH + "SELECT id FROM runs r WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.run_id = r.id AND l.org_id IS NOT DISTINCT FROM r.org_id AND l.reason = 'refund')")
def has_refund(spark, d):
    return R.refunded(runs(spark, d), ledger(spark, d)).select("id")


@query(_WITH + "SELECT org_id, CAST(coalesce(sum(amount), 0) AS BIGINT) AS balance FROM ledger GROUP BY org_id")
def ledger_balance(spark, d):
    return R.balance(ledger(spark, d))


@query(_WITH + "SELECT run_id, reason, amount FROM ledger UNION ALL SELECT id, 'debit', credit_cost FROM runs WHERE credit_cost > 0 AND k % 4 = 0")
def ledger_idempotent(spark, d):
    old = ledger(spark, d).select("run_id", "reason", "amount")
    return R.once(old, R.debits(runs(spark, d)).selectExpr("run_id", "reason", "amount", "run_id AS id")).select("run_id", "reason", "amount")


@query(_WITH + "SELECT org_id, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, min(id) FILTER (status = 'failed') AS first_failed FROM runs GROUP BY org_id")
def status_buckets(spark, d):
    b = R.buckets(runs(spark, d), "org_id", "id", statuses=("failed", "running"))
    return b.select("org_id", F.size("failed").cast("bigint").alias("failed"), F.size("running").cast("bigint").alias("running"), F.try_element_at("failed", F.lit(1)).alias("first_failed"))


_BRANCH = "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'suspended' ELSE CASE WHEN l_quantity > 45 THEN 'paused' ELSE 'completed' END END"


@query(f"SELECT l_orderkey, CASE max(CASE s WHEN 'failed' THEN 4 WHEN 'paused' THEN 3 WHEN 'suspended' THEN 2 ELSE 1 END) WHEN 4 THEN 'failed' WHEN 3 THEN 'paused' WHEN 2 THEN 'suspended' ELSE 'completed' END AS final_status FROM (SELECT l_orderkey, {_BRANCH} AS s FROM lineitem) GROUP BY l_orderkey")
def final_status(spark, d):
    return R.final_status(table(spark, d, "lineitem").selectExpr("l_orderkey", f"{_BRANCH} AS status"), "l_orderkey")


_REASON = "CASE event_type WHEN 'view' THEN 'sleeping' WHEN 'purchase' THEN 'paused' ELSE 'waiting_signal' END"


@query(f"SELECT user_id, min(ts) AS wake_at, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS topics, CASE max(CASE r WHEN 'paused' THEN 3 WHEN 'sleeping' THEN 2 ELSE 1 END) WHEN 3 THEN 'paused' WHEN 2 THEN 'sleeping' ELSE 'waiting_signal' END AS reason FROM (SELECT *, {_REASON} AS r FROM events) GROUP BY user_id")
def suspension_summary(spark, d):
    w = table(spark, d, "events").selectExpr("user_id", "ts AS wake_at", "event_type AS topic", f"{_REASON} AS reason")
    return R.suspension(w, "user_id").withColumn("topics", F.concat_ws(",", "topics"))


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def progress_latest(spark, d):
    return R.latest_progress(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS INT) AS attempt FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events)")
def progress_attempt(spark, d):
    return R.attempts(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "attempt")


_STARTED = "CASE WHEN event_type = 'view' THEN NULL ELSE ts END"


@query(f"SELECT event_id, event_type AS step_name, {_STARTED} AS started_at FROM events WHERE user_id = 7 ORDER BY started_at ASC NULLS LAST, step_name, event_id LIMIT 20")
def progress_order(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "user_id AS execution_id", "event_type AS step_name", "event_id AS branch_id", f"{_STARTED} AS started_at")
    return R.progress_list(e, 7).limit(20).select("event_id", "step_name", "started_at")


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS seq, l_linenumber FROM lineitem")
def branch_sequence(spark, d):
    return R.sequenced(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).select("l_orderkey", "seq", "l_linenumber")


@query("SELECT event_id AS seq, event_type FROM events WHERE user_id = 11 AND event_id > 500 ORDER BY event_id")
def event_tail(spark, d):
    return R.tail(table(spark, d, "events").withColumnRenamed("event_id", "seq"), F.col("user_id") == 11, 500).select("seq", "event_type")


@query(_WITH + f"SELECT id FROM runs WHERE created_at >= {NOW_SQL}")
def event_retention(spark, d):
    return R.retained(runs(spark, d), F.expr(NOW)).select("id")


@query(_WAITS + "SELECT w.exec_id, w.seq AS wait_seq, s.seq AS signal_seq, s.payload FROM (SELECT *, row_number() OVER (PARTITION BY exec_id, topic ORDER BY start, seq) AS rn FROM waits) w JOIN (SELECT *, row_number() OVER (PARTITION BY exec_id, topic ORDER BY ts, seq) AS rn FROM signals) s ON w.exec_id = s.exec_id AND w.topic = s.topic AND w.rn = s.rn")
def signal_fifo_match(spark, d):
    return R.rendezvous(waits(spark, d).withColumnRenamed("seq", "wait_seq"), signals(spark, d).withColumnRenamed("seq", "signal_seq"), ["exec_id", "topic"], ["start", "wait_seq"], ["ts", "signal_seq"]).select("exec_id", "wait_seq", "signal_seq", "payload")


@query(_WAITS + ", f AS (SELECT exec_id, min(ts) AS f FROM signals GROUP BY exec_id) SELECT w.seq, CASE WHEN f <= wake_at THEN 'received' WHEN wake_at <= TIMESTAMP '2024-01-15 00:00:00' THEN 'timeout' ELSE 'waiting' END AS outcome FROM waits w LEFT JOIN f ON w.exec_id = f.exec_id")
def signal_wait_timeout(spark, d):
    return R.wait_outcome(waits(spark, d), signals(spark, d), ["exec_id", "topic"], _ntz("2024-01-15 00:00:00")).select("seq", "outcome")


@query(_WAITS + "SELECT exec_id, seq FROM waits WHERE wake_at <= TIMESTAMP '2024-01-15 00:00:00'")
def sleep_due(spark, d):
    return due(waits(spark, d), _ntz("2024-01-15 00:00:00")).select("exec_id", "seq")


@query(_WAITS + "SELECT seq, greatest(date_diff('microsecond', TIMESTAMP '2024-01-15 00:00:00', wake_at), 0) AS micros FROM waits")
def pause_freeze_thaw(spark, d):
    return waits(spark, d).select("seq", S.remaining(F.col("wake_at"), _ntz("2024-01-15 00:00:00")).alias("micros"))


_OUTBOX = "SELECT id, CASE status WHEN 'queued' THEN 'pending' ELSE status END AS status, attempt AS attempts, created_at FROM {runs}"


def _outbox(spark, d):
    return spark.sql(_OUTBOX, runs=runs(spark, d))


@query(_WITH + "SELECT id, attempts FROM (" + _OUTBOX.format(runs="runs") + ") WHERE status = 'pending' ORDER BY created_at, id LIMIT 10")
def outbox_pending(spark, d):
    return R.pending(_outbox(spark, d)).select("id", "attempts")


@query(_WITH + "SELECT id, CASE WHEN attempts = 2 AND status = 'pending' THEN 'processing' ELSE status END AS status FROM (" + _OUTBOX.format(runs="runs") + ")")
def outbox_cas(spark, d):
    return R.to_processing(_outbox(spark, d), F.col("attempts") == 2).select("id", "status")


@query(_WITH + "SELECT id, CASE WHEN status = 'pending' THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN status = 'pending' THEN attempts + 1 ELSE attempts END AS attempts FROM (" + _OUTBOX.format(runs="runs") + ")")
def outbox_attempt(spark, d):
    o = _outbox(spark, d).withColumn("error_message", F.lit(""))
    return R.failed_attempt(o, F.col("status") == "pending", "no answer", max_attempts=3).select("id", "status", "attempts")


@query(_WITH + "SELECT p.id AS parent, c.id AS child, c.status AS child_status FROM runs p JOIN runs c ON p.id = c.parent_run_id")
def parent_child(spark, d):
    return R.children(runs(spark, d), [F.col("status").alias("child_status")])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 1")
def name_dupes(spark, d):
    return R.duplicates(table(spark, d, "events"), "event_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def key_difference(spark, d):
    return R.unknown_keys(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("WITH RECURSIVE t AS (SELECT o_orderkey AS exec_id, CAST(1 AS BIGINT) AS counter, o_orderkey % 5 AS most FROM orders UNION ALL SELECT exec_id, counter + 1, most FROM t WHERE counter <= most) SELECT exec_id, max(counter) AS counter FROM t GROUP BY exec_id")
def loop_counter(spark, d):
    d_ = from_dict({"name": "loop", "inputs": _inputs("most"), "outputs": [{"name": "counter"}], "state": {"counter": 1}, "steps": [
        {"name": "check", "activity": "label", "parameters": {"value": "${state.counter}"}, "store": "seen", "edge_matching": "first", "next": [{"step": "more", "condition": "state.counter <= inputs.most"}, {"step": "end"}]},
        {"name": "more", "activity": "label", "parameters": {"value": "${state.counter + 1}"}, "store": "counter", "next": [{"step": "check"}]},
        {"name": "end", "activity": "label", "parameters": {"value": "${state.counter}"}, "store": "counter"}]})
    return Compiler(d_, _REGISTRY).compile(_orders(spark, d).withColumn("most", F.col("o_orderkey") % 5), columns={"most": "most"}).outputs.select(KEY, F.col("counter").cast("bigint").alias("counter"))


@query(_WITH + "SELECT id, date_diff('microsecond', created_at, completed_at) AS micros FROM runs")
def duration(spark, d):
    return runs(spark, d).select("id", R.duration(F.col("created_at"), F.col("completed_at")).alias("micros"))


@query(_WITH + ", a AS (SELECT id, status FROM runs WHERE k % 3 <> 0), b AS (SELECT id, CASE WHEN k % 5 = 0 THEN 'changed' ELSE status END AS status FROM runs WHERE k % 4 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'add' WHEN b.id IS NULL THEN 'delete' ELSE 'modify' END AS change, b.status FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status")
def state_diff(spark, d):
    r = runs(spark, d)
    return R.state_diff(r.where("k % 3 <> 0"), r.where("k % 4 <> 0").selectExpr("id", "CASE WHEN k % 5 = 0 THEN 'changed' ELSE status END AS status"), "id", "status")


@query(_WITH + "SELECT id, coalesce(org_id, '') AS org_id, nullif(definition_type, '5-LOW') AS definition_type, regexp_matches(id, '^[A-Za-z_][A-Za-z0-9_]*$') AS is_identifier FROM runs")
def null_mapping(spark, d):
    return runs(spark, d).select("id", S.empty_if_null(F.col("org_id")).alias("org_id"), F.nullif("definition_type", F.lit("5-LOW")).alias("definition_type"), S.is_identifier(F.col("id")).alias("is_identifier"))


@query()
def random_number(spark, d):
    return spark.range(1000).select("id", G.number(5, 9).alias("n"), G.real(1.0, 2.0).alias("x"))


@query()
def uuid_v4(spark, d):
    return spark.range(1000).select("id", G.uuid().alias("uuid"), G.hexadecimal().alias("hex"))


# the rest of the queries, which use what is above, add themselves to QUERIES and SQL
from loomgraph import graph_queries, store_queries  # noqa: E402, F401
