"""Queries of stored tables: the worker's cycle, outboxes, checkpoints, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import runs as R
from loomgraph.queries import _LEASE, _OUTBOX, _STALE, _WAITS, _WITH, NOW, NOW_SQL, _ntz, _outbox, ledger, query, runs, table, waits
from loomgraph.sources import tables as TB

_AFTER = f"CASE WHEN {_STALE} AND attempt >= 2 THEN 'failed' WHEN {_STALE} AND attempt < 2 THEN 'queued' ELSE status END"


@query(_WITH + f"SELECT id, {_AFTER} AS status FROM runs")
def reaper_runs(spark, d):
    r = runs(spark, d).withColumn("error_message", F.lit(""))
    return R.reap(r, ledger(spark, d).drop("org_id"), F.expr(NOW), 2, F.expr(NOW), ["run-2", "run-4"])[0].select("id", "status")


@query(_WITH + f", after AS (SELECT id, credit_cost, {_AFTER} AS status FROM runs) SELECT run_id, reason, amount FROM ledger UNION ALL SELECT id, 'refund', -credit_cost FROM after WHERE status = 'failed' AND credit_cost > 0 AND id IN (SELECT run_id FROM ledger WHERE reason = 'debit') AND id NOT IN (SELECT run_id FROM ledger WHERE reason = 'refund')")
def reaper_ledger(spark, d):
    r = runs(spark, d).withColumn("error_message", F.lit(""))
    return R.reap(r, ledger(spark, d).select("run_id", "reason", "amount"), F.expr(NOW), 2, F.expr(NOW), ["run-2", "run-4"])[1].select("run_id", "reason", "amount")


_TEN = ", c AS (SELECT id FROM runs WHERE status = 'queued' ORDER BY created_at, id LIMIT 10) "


@query(_WITH + _TEN + "SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'running' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM c) THEN attempt + 1 ELSE attempt END AS attempt FROM runs")
def claim_batch(spark, d):
    r = runs(spark, d).withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    return R.claim_batch(r, "w", F.expr(NOW), 10).select("id", "status", "attempt")


def _moved(spark, d):
    """Runs before and after a worker's round, in which every third running one has ended."""
    r = runs(spark, d).withColumns({"callback_url": F.when(F.col("k") % 2 == 0, F.concat(F.lit("https://example.com/"), F.col("id"))).otherwise("")})
    after = R.changed(r, (F.col("status") == "running") & (F.col("k") % 3 == 0), status=F.when(F.col("k") % 4 == 0, "failed").otherwise("completed"))
    return R.transitions(r, R.changed(after, (F.col("status") == "queued") & (F.col("k") % 5 == 0), status="running"))


_MOVED = ", m AS (SELECT *, CASE WHEN k % 2 = 0 THEN concat('https://example.com/', id) ELSE '' END AS url, CASE WHEN status = 'queued' THEN 'running' WHEN k % 4 = 0 THEN 'failed' ELSE 'completed' END AS now_ FROM runs WHERE (status = 'running' AND k % 3 = 0) OR (status = 'queued' AND k % 5 = 0)) "


@query(_WITH + _MOVED + "SELECT id AS run_id, concat('run.', now_) AS event_type, attempt, claimed_by AS worker_id FROM m")
def lifecycle_events(spark, d):
    return R.lifecycle_events(_moved(spark, d), F.expr(NOW)).select("run_id", "event_type", "attempt", "worker_id")


@query(_WITH + _MOVED + "SELECT concat('hook-', id, '-', now_) AS id, id AS run_id, url, concat('{\"run_id\":\"', id, '\",\"status\":\"', now_, '\"}') AS payload, 'pending' AS status FROM m WHERE now_ <> 'running' AND url <> ''")
def webhooks_enqueued(spark, d):
    return R.webhooks_due(_moved(spark, d), F.expr(NOW)).select("id", "run_id", "url", "payload", "status")


_SPECS = "SELECT id AS parent_run_id, concat('next-', CAST(k % 3 AS {s})) AS child_spec FROM {r} WHERE k % 2 = 1 OR k % 9 = 0"
_TRIGGERS = _MOVED + ", s AS (" + _SPECS.format(s="VARCHAR", r="runs") + "), t AS (SELECT concat('trig_', substr(sha256(concat('{\"k0\":\"', s.parent_run_id, '\",\"k1\":\"', child_spec, '\"}')), 1, 26)) AS id, s.parent_run_id, child_spec FROM s JOIN m ON m.id = s.parent_run_id WHERE now_ = 'completed') "


def _triggers(spark, d):
    return R.triggers_due(_moved(spark, d), spark.sql(_SPECS.format(s="STRING", r="{r}"), r=runs(spark, d)), F.expr(NOW))


@query(_WITH + _TRIGGERS + "SELECT id, parent_run_id, child_spec, 'pending' AS status FROM t")
def triggers_inserted(spark, d):
    return _triggers(spark, d).select("id", "parent_run_id", "child_spec", "status")


@query(_WITH + _TRIGGERS + "SELECT replace(t.id, 'trig_', 'run_') AS id, parent_run_id, org_id, child_spec AS definition_type, 'queued' AS status FROM t JOIN (SELECT id AS parent_run_id, org_id FROM runs) USING (parent_run_id)")
def children_enqueued(spark, d):
    t = R.to_processing(_triggers(spark, d), F.lit(True))
    none = runs(spark, d).select("id", "status", "attempt").limit(0)
    return R.enqueue(none, R.children_of(t, runs(spark, d))).select("id", "parent_run_id", "org_id", "definition_type", "status")


@query(_WITH + "SELECT id, status, CASE WHEN status = 'pending' THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN status = 'pending' THEN 'gone' ELSE '' END AS last_error FROM (" + _OUTBOX.format(runs="runs") + ")")
def webhook_attempts(spark, d):
    o = _outbox(spark, d).withColumn("last_error", F.lit(""))
    return R.webhook_attempt(o, F.col("status") == "pending", "gone").select("id", "status", "attempts", "last_error")


@query(_WITH + f"SELECT id, CASE WHEN attempts = 1 THEN 'delivered' ELSE status END AS status, CASE WHEN attempts = 1 THEN {NOW_SQL} END AS delivered_at FROM (" + _OUTBOX.format(runs="runs") + ")")
def outbox_finished(spark, d):
    o = _outbox(spark, d).withColumn("delivered_at", F.lit(None).cast("timestamp_ntz"))
    return R.finished(o, F.col("attempts") == 1, "delivered", "delivered_at", F.expr(NOW)).select("id", "status", "delivered_at")


@query(_WITH + "SELECT id FROM runs WHERE status = 'failed' AND credit_cost > 0")
def refund_candidates(spark, d):
    return R.refund_candidates(runs(spark, d)).select("id")


@query(_WITH + f"SELECT id, CASE WHEN {_LEASE} AND status = 'running' THEN {NOW_SQL} ELSE heartbeat_at END AS heartbeat_at FROM runs")
def heartbeat_post_state(spark, d):
    return R.heartbeat(runs(spark, d), F.expr(f"{_LEASE} AND status = 'running'"), F.expr(NOW)).select("id", "heartbeat_at")


@query(_WITH + "SELECT id, CASE WHEN id = 'run-7' AND claimed_by = 'worker-1' AND attempt = 3 THEN 'new' ELSE tag END AS spec FROM runs")
def update_spec_post_state(spark, d):
    r = runs(spark, d).withColumn("spec", F.col("tag").cast("binary"))
    return R.update_spec(r, R.fence("run-7", "worker-1", 3), b"new").select("id", F.col("spec").cast("string").alias("spec"))


@query(_WITH + f"SELECT id, CASE WHEN {_LEASE} THEN NULL ELSE tag END AS checkpoint FROM runs")
def checkpoint_cleared(spark, d):
    r = runs(spark, d).withColumn("checkpoint", F.col("tag").cast("binary"))
    return R.save_checkpoint(r, F.expr(_LEASE), None).select("id", F.col("checkpoint").cast("string").alias("checkpoint"))


@query(_WITH + f"SELECT id, {_LEASE} AND status = 'running' AS held FROM runs")
def fenced_checkpoint(spark, d):
    """A snapshot is saved only under the lease."""
    r = runs(spark, d).withColumn("checkpoint", F.lit(None).cast("binary"))
    return R.save_checkpoint(r, F.expr(f"{_LEASE} AND status = 'running'"), b"s").select("id", F.col("checkpoint").isNotNull().alias("held"))


_CHECKPOINTS = "SELECT concat('e', CAST(l_orderkey AS {s})) AS execution_id, CAST(l_linenumber AS BIGINT) AS number, 1 AS schema_version, l_linestatus AS status, CAST(l_quantity AS {s}) AS state, l_shipdate AS start_time, CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL {day} END AS end_time, l_shipdate + INTERVAL {two} AS checkpoint_at FROM {l}"
_LINES = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) = 1)"
_LATEST = "SELECT * FROM (" + _CHECKPOINTS.format(s="VARCHAR", day="1 DAY", two="2 DAY", l=_LINES) + ") QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY number DESC) = 1"


def _checkpoints(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_linestatus")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    return spark.sql(_CHECKPOINTS.format(s="STRING", day="'1' DAY", two="'2' DAY", l="{l}"), l=first)


@query(f"SELECT execution_id, number, state FROM ({_LATEST})")
def latest_checkpoints(spark, d):
    return TB.latest_checkpoints(_checkpoints(spark, d)).where("schema_version = 1").select("execution_id", "number", "state")


@query(f"SELECT execution_id, status, start_time, date_diff('microsecond', start_time, coalesce(end_time, checkpoint_at)) AS micros FROM ({_LATEST})")
def execution_summaries(spark, d):
    return TB.execution_summaries(_checkpoints(spark, d))


@query(f"SELECT execution_id, count(*) AS n FROM ({_CHECKPOINTS.format(s='VARCHAR', day='1 DAY', two='2 DAY', l=_LINES)}) WHERE execution_id <> 'e1' GROUP BY execution_id")
def checkpoints_deleted(spark, d):
    return TB.without_execution(_checkpoints(spark, d), "e1").groupBy("execution_id").agg(F.count(F.lit(1)).alias("n"))


_BRANCHES = "SELECT seq AS id, wake_at, FALSE AS paused, '' AS pause_reason, CAST(NULL AS BIGINT) AS remaining FROM {w}"


def _branches(spark, d):
    return spark.sql(_BRANCHES.format(w="{w}"), w=waits(spark, d))


@query(_WAITS + "SELECT seq AS id, seq % 3 = 0 AS paused, CASE WHEN seq % 3 = 0 THEN NULL ELSE wake_at END AS wake_at, CASE WHEN seq % 3 = 0 THEN greatest(date_diff('microsecond', TIMESTAMP '2024-01-15 00:00:00', wake_at), 0) END AS remaining FROM waits")
def branches_paused(spark, d):
    b = R.paused(_branches(spark, d), F.col("id") % 3 == 0, "why", _ntz("2024-01-15 00:00:00"))
    return b.select("id", "paused", "wake_at", "remaining")


@query(_WAITS + "SELECT seq AS id, FALSE AS paused, CASE WHEN seq % 3 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' + to_microseconds(greatest(date_diff('microsecond', TIMESTAMP '2024-01-15 00:00:00', wake_at), 0)) ELSE wake_at END AS wake_at FROM waits")
def branches_unpaused(spark, d):
    b = R.paused(_branches(spark, d), F.col("id") % 3 == 0, "why", _ntz("2024-01-15 00:00:00"))
    return R.unpaused(b, F.lit(True), _ntz("2024-01-20 00:00:00")).select("id", "paused", "wake_at")


@query("SELECT event_id AS seq, event_type FROM events WHERE event_type <> 'purchase' UNION ALL SELECT (SELECT max(event_id) FROM events WHERE event_type <> 'purchase') + row_number() OVER (ORDER BY event_id), event_type FROM events WHERE event_type = 'purchase'")
def events_numbered(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    old = e.where("event_type <> 'purchase'").withColumnRenamed("event_id", "seq")
    return R.numbered(old, e.where("event_type = 'purchase'"), ["event_id"]).select("seq", "event_type")


@query("SELECT user_id, ts, event_id FROM events WHERE user_id = 3 ORDER BY ts, event_id")
def activity_history(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS execution_id", "ts AS start_time", "event_id AS id")
    return TB.history_of(e, 3).selectExpr("execution_id AS user_id", "start_time AS ts", "id AS event_id")


@query(_WITH + "SELECT id, coalesce(org_id, '') AS org_id, coalesce(parent_run_id, '') AS parent_run_id, status FROM runs")
def runs_scanned(spark, d):
    return TB.scan_runs(runs(spark, d)).select("id", "org_id", "parent_run_id", "status")


@query(_WITH + "SELECT id, status, nullif(claimed_by, 'worker-0') AS claimed_by FROM runs")
def emptied_to_null(spark, d):
    r = runs(spark, d).withColumn("claimed_by", F.when(F.col("claimed_by") == "worker-0", "").otherwise(F.col("claimed_by")))
    return TB.emptied_to_null(r, ["claimed_by"]).select("id", "status", "claimed_by")


_CODES = "CASE event_id % 6 WHEN 0 THEN 'deadline_exceeded' WHEN 1 THEN 'wait_timeout' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'fatal_error' WHEN 4 THEN 'timeout' ELSE 'other' END"


@query("SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 4) THEN 'timeout' WHEN event_id % 6 = 3 THEN 'fatal_error' ELSE 'activity_failed' END AS kind, event_type AS cause FROM events")
def error_records(spark, d):
    e = table(spark, d, "events").select("event_id", S.error_record(S.classify(F.expr(_CODES)), F.col("event_type"), F.lit(None).cast("string")).alias("r"))
    return e.select("event_id", F.col("r.Error").alias("kind"), F.col("r.Cause").alias("cause"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, ts FROM events")
def time_codec(spark, d):
    e = table(spark, d, "events").select("event_id", S.to_utc_text(F.col("ts")).alias("text"))
    return e.select("event_id", "text", F.to_timestamp_ntz(F.regexp_replace("text", "Z$", "")).alias("ts"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE concat('{\"a\":\"', event_type, '\"}') END AS text, CASE WHEN event_type <> 'view' THEN event_type END AS a FROM events")
def metadata_codec(spark, d):
    m = F.map_filter(F.create_map(F.lit("a"), F.col("event_type")), lambda _, v: v != "view")
    e = table(spark, d, "events").select("event_id", S.metadata_json(m).alias("text"))
    return e.select("event_id", "text", S.metadata_map(F.col("text"))["a"].alias("a"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 493 WHEN 1 THEN 384 WHEN 2 THEN 420 ELSE 420 END AS mode FROM orders")
def file_modes(spark, d):
    given = F.element_at(F.array(*map(F.lit, ("0755", "384", "0644", "rwx"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.permissions(given).alias("mode"))


@query("SELECT o_orderkey, concat('run_', substr(sha256(concat('{\"k0\":', CAST(o_orderkey AS VARCHAR), '}')), 1, 26)) AS id FROM orders")
def minted_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.minted("run_", F.col("o_orderkey")).alias("id"))


_SIGNS = "abcdefghijklmnopqrstuvwxyz234567"


@query(f"SELECT o_orderkey, concat('exec_', array_to_string([substr('{_SIGNS}', CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INT) % 32 + 1, 1) FOR i IN range(26)], '')) AS id FROM (SELECT o_orderkey, sha256(concat('{{\"k0\":', CAST(o_orderkey AS VARCHAR), '}}')) AS h FROM orders)")
def execution_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.execution_id(F.col("o_orderkey")).alias("id"))


_PURCHASES = "SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'"


@query(f"SELECT user_id, event_id FROM ({_PURCHASES}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def signals_received(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    # sent in two parts, received in one order
    sent = R.send(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))
    return R.receive(sent, ["user_id"], ["ts", "event_id"])[0].select("user_id", "event_id")


@query(f"SELECT user_id, event_id FROM ({_PURCHASES}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1")
def signals_left(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return R.receive(e, ["user_id"], ["ts", "event_id"])[1].select("user_id", "event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_stringify(spark, d):
    return table(spark, d, "events").select("event_id", S.json_query(S.json_stringify(F.col("props")), "k").alias("k"))


@query(_WITH + ", a AS (SELECT id, status FROM runs WHERE k % 3 <> 0), b AS (SELECT id, CASE WHEN k % 5 = 0 THEN 'changed' ELSE status END AS status FROM runs WHERE k % 4 <> 0) SELECT id, status FROM b")
def state_patched(spark, d):
    """What differs, put on what was, gives what is."""
    r = runs(spark, d)
    before, after = r.where("k % 3 <> 0"), r.where("k % 4 <> 0").selectExpr("id", "CASE WHEN k % 5 = 0 THEN 'changed' ELSE status END AS status")
    return R.patched(before, R.state_diff(before, after, "id", "status"), "id", "status")


@query(_WITH + "SELECT org_id FROM (SELECT org_id, count(DISTINCT status) FILTER (status IN ('failed', 'running')) AS n FROM runs WHERE org_id IS NOT NULL GROUP BY org_id) WHERE n = 2")
def ready_by_name(spark, d):
    b = runs(spark, d).where("org_id IS NOT NULL").selectExpr("org_id", "status AS branch_id", "'completed' AS status")
    return R.ready_by_name(b, "org_id", ["failed", "running"])


@query(_WITH + "SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) AS balance FROM ledger WHERE org_id = 'org-3'")
def balance_of(spark, d):
    return R.balance_of(ledger(spark, d), "org-3")


@query(_WITH + "SELECT id, status, CASE WHEN " + _STALE + " AND attempt >= 2 THEN 'too many attempts' ELSE '' END AS error_message FROM (SELECT * REPLACE (CASE WHEN " + _STALE + " AND attempt >= 2 THEN 'failed' ELSE status END AS status), status AS was FROM runs) WHERE FALSE UNION ALL SELECT id, CASE WHEN " + _STALE + " AND attempt >= 2 THEN 'failed' ELSE status END, CASE WHEN " + _STALE + " AND attempt >= 2 THEN 'too many attempts' ELSE '' END FROM runs")
def dead_letter_post_state(spark, d):
    r = runs(spark, d).withColumn("error_message", F.lit(""))
    return R.dead_letter(r, F.expr(NOW), 2, F.expr(NOW), ["run-2", "run-4"]).select("id", "status", "error_message")
