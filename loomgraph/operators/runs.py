"""Queries over the history of runs, and changes of it as copy-on-write: each change takes a table and gives the table
as it is afterwards."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S

PAGE = 50


@dataclass
class RunFilter:
    """What a listing asks for; what is empty isn't asked for. cursor: (created_at, id) of the last row seen."""

    definition_type: str = ""
    status: str = ""
    project_id: str = ""
    parent_run_id: str = ""
    initiated_by: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    cursor: tuple | None = None
    limit: int = 0


def scope(org_id: str) -> Column:
    return F.col("org_id") == org_id if org_id else F.col("org_id").isNull()


def where(org_id: str, f: RunFilter, cursor: bool = True) -> Column:
    conds = [scope(org_id)]
    conds += [F.col(c) == v for c in ("definition_type", "status", "project_id", "parent_run_id", "initiated_by") if (v := getattr(f, c))]
    if f.metadata:
        conds.append(S.contains(F.col("metadata"), f.metadata))
    if cursor and f.cursor:
        at, ident = (F.lit(x) for x in f.cursor)
        # written out, so that the comparison of created_at reaches the scan
        conds.append((F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col("id") < ident)))
    return reduce(lambda a, b: a & b, conds)


class NotFound(LookupError):
    """There is no such run, or it is of another organisation."""


def fetch(runs: DataFrame, org_id: str, run_id: str):
    """The row of a run, or NotFound."""
    row = get(runs, org_id, run_id).first()
    if row is None:
        raise NotFound(run_id)
    return row


def get(runs: DataFrame, org_id: str, run_id: str) -> DataFrame:
    return runs.where((F.col("id") == run_id) & scope(org_id)).limit(1)


def page(runs: DataFrame, org_id: str, f: RunFilter) -> DataFrame:
    """Newest first, one row more than the limit: if it is there, there is another page."""
    return runs.where(where(org_id, f)).orderBy(F.desc("created_at"), F.desc("id")).limit((f.limit or PAGE) + 1)


def paged(runs: DataFrame, org_id: str, f: RunFilter) -> tuple[list, tuple | None]:
    """A page's rows, and the cursor of the next page if there is one."""
    rows, n = page(runs, org_id, f).collect(), f.limit or PAGE
    return rows[:n], (rows[n - 1]["created_at"], rows[n - 1]["id"]) if len(rows) > n else None


def count(runs: DataFrame, org_id: str, f: RunFilter) -> DataFrame:
    """(n) of all that the filter lets through, whatever cursor and limit."""
    return runs.where(where(org_id, f, cursor=False)).agg(F.count(F.lit(1)).alias("n"))


def children(runs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(parent, child) of runs that began others."""
    return runs.select(F.col("id").alias("parent")).join(runs.select(F.col("id").alias("child"), F.col("parent_run_id").alias("parent"), *(columns or [])), "parent")


# the queue


def claimable(runs: DataFrame) -> DataFrame:
    """The oldest queued run."""
    return runs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def changed(runs: DataFrame, when: Column, **to) -> DataFrame:
    """runs with columns changed where a condition is true; a missing value is no."""
    hit = F.coalesce(when, F.lit(False))
    return runs.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in to.items()})


def claim(runs: DataFrame, worker: str, now) -> DataFrame:
    """The oldest queued run set to running: a start that it had stays, its attempts go up by one."""
    first = claimable(runs).select(F.col("id").alias("_claimed"))
    joined = runs.join(F.broadcast(first), F.col("id") == F.col("_claimed"), "left")  # one row at most
    return changed(joined, F.col("_claimed").isNotNull(), status="running", claimed_by=worker, heartbeat_at=F.lit(now), started_at=F.coalesce("started_at", F.lit(now)), attempt=F.col("attempt") + 1).drop("_claimed")


def claim_batch(runs: DataFrame, worker: str, now, capacity: int) -> DataFrame:
    """The oldest queued runs, as many as a worker has room for, set to running as by claim(). capacity is a worker's limit
    of runs at once, so what is broadcast is as small."""
    first = runs.where("status = 'queued'").orderBy("created_at", "id").limit(capacity).select(F.col("id").alias("_claimed"))
    joined = runs.join(F.broadcast(first), F.col("id") == F.col("_claimed"), "left")
    return changed(joined, F.col("_claimed").isNotNull(), status="running", claimed_by=worker, heartbeat_at=F.lit(now), started_at=F.coalesce("started_at", F.lit(now)), attempt=F.col("attempt") + 1).drop("_claimed")


def enqueue(runs: DataFrame, new: DataFrame, skip: bool = False) -> DataFrame:
    """The table with new runs, queued, attempt 0. An id that is there already, or twice among the new ones, is an error
    when the table is read; with skip, its first row counts and the others are left out."""
    new = new.withColumns({"status": F.lit("queued"), "attempt": F.lit(0)})
    if skip:
        return runs.unionByName(new.dropDuplicates(["id"]).join(runs.select("id"), "id", "left_anti"), allowMissingColumns=True)
    known = runs.select("id").distinct().withColumn("_known", F.lit(True))
    twice = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    checked = new.join(known, "id", "left").withColumn("_bad", F.col("_known").isNotNull() | twice)
    error = F.raise_error(F.concat(F.lit("a run has the id "), F.col("id").cast("string"))).cast("boolean")
    # as a filter, so that no reader can do without it
    return runs.unionByName(checked.where(F.when(F.col("_bad"), error).otherwise(True)).drop("_known", "_bad"), allowMissingColumns=True)


def fence(run_id: str, worker: str, attempt: int, running: bool = False) -> Column:
    out = (F.col("id") == run_id) & (F.col("claimed_by") == worker) & (F.col("attempt") == attempt)
    return out & (F.col("status") == "running") if running else out


def complete(runs: DataFrame, lease: Column, status: str, now, error: str = "", result: Column | None = None) -> DataFrame:
    """The run under a lease set to its outcome; it gets an end only if that is completed or failed."""
    to = {"status": status, "error_message": error}
    if status in ("completed", "failed"):
        to["completed_at"] = F.lit(now)
    if result is not None:
        to["result"] = result
    return changed(runs, lease, **to)


def heartbeat(runs: DataFrame, lease: Column, now) -> DataFrame:
    return changed(runs, lease, heartbeat_at=F.lit(now))


def update_spec(runs: DataFrame, lease: Column, spec: bytes) -> DataFrame:
    return changed(runs, lease, spec=F.lit(spec))


def save_checkpoint(runs: DataFrame, lease: Column, snapshot: bytes | None) -> DataFrame:
    """A snapshot in the run's row; None clears it."""
    return changed(runs, lease, checkpoint=F.lit(snapshot).cast("binary"))


def stale(before, exclude: list[str] | None = None) -> Column:
    out = (F.col("status") == "running") & (F.col("heartbeat_at") < F.lit(before))
    return out & ~F.col("id").isin(list(exclude)) if exclude else out


def reclaim(runs: DataFrame, before, max_attempts: int, exclude: list[str] | None = None) -> DataFrame:
    """Stale runs with attempts left are queued again, without a worker."""
    return changed(runs, stale(before, exclude) & (F.col("attempt") < max_attempts), status="queued", claimed_by="", heartbeat_at=F.lit(None))


def dead_letters(runs: DataFrame, before, max_attempts: int, exclude: list[str] | None = None) -> DataFrame:
    return runs.where(stale(before, exclude) & (F.col("attempt") >= max_attempts))


def dead_letter(runs: DataFrame, before, max_attempts: int, now, exclude: list[str] | None = None) -> DataFrame:
    """Stale runs without attempts left have failed."""
    return changed(runs, stale(before, exclude) & (F.col("attempt") >= max_attempts), status="failed", error_message="too many attempts", completed_at=F.lit(now))


def affected(runs: DataFrame, when: Column) -> DataFrame:
    """(n) of the rows that a change would touch."""
    return runs.agg(F.count_if(F.coalesce(when, F.lit(False))).alias("n"))


def delete(runs: DataFrame, org_id: str, run_id: str) -> DataFrame:
    """The table without a run, unless that is running."""
    return runs.where(~F.coalesce((F.col("id") == run_id) & scope(org_id) & (F.col("status") != "running"), F.lit(False)))


def deletion(runs: DataFrame, org_id: str, run_id: str) -> str:
    """Why delete() would leave a run: missing, running, or "" if it wouldn't."""
    row = get(runs, org_id, run_id).select("status").first()
    return "missing" if row is None else "running" if row["status"] == "running" else ""


def checkpoint_of(runs: DataFrame, run_id: str) -> bytes:
    """The snapshot in a run's row; NotFound if there is none."""
    row = runs.where(F.col("id") == run_id).select("checkpoint").first()
    if row is None or row["checkpoint"] is None:
        raise NotFound(f"checkpoint of {run_id}")
    return bytes(row["checkpoint"])


def reap(runs: DataFrame, ledger: DataFrame, before, max_attempts: int, now, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A round of the reaper: the runs after stale ones have failed or are queued again, and the ledger with what is then
    due to be refunded. In this order, so that what has just failed is refunded in the same round."""
    after = reclaim(dead_letter(runs, before, max_attempts, now, exclude), before, max_attempts, exclude)
    return after, once(ledger, refunds(refund_pending(after, ledger)).withColumn("id", F.concat(F.lit("refund-"), F.col("run_id"))))


def duration(start: Column, end: Column, checkpoint_at: Column | None = None) -> Column:
    """Microseconds from start to end, or, of what hasn't ended, to its last checkpoint."""
    return F.timestamp_diff("MICROSECOND", start, end if checkpoint_at is None else F.coalesce(end, checkpoint_at))


# the ledger


def balance(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("org_id").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("bigint").alias("balance"))


def balance_of(ledger: DataFrame, org_id: str) -> DataFrame:
    """(balance) of an organisation; 0 if it has no rows."""
    return ledger.where(F.col("org_id") == org_id).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("bigint").alias("balance"))


def once(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with the new rows whose (run_id, reason) isn't there yet; of several, the first by id."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy("run_id", "reason").orderBy("id"))).where("_r = 1").drop("_r")
    return ledger.unionByName(first.join(ledger.select("run_id", "reason"), ["run_id", "reason"], "left_anti"), allowMissingColumns=True)


def debits(runs: DataFrame) -> DataFrame:
    return runs.where("credit_cost > 0").selectExpr("org_id", "id AS run_id", "definition_type", "credit_cost AS amount", "'debit' AS reason")


def refunds(pending: DataFrame) -> DataFrame:
    return pending.selectExpr("org_id", "id AS run_id", "definition_type", "-credit_cost AS amount", "'refund' AS reason")


def refund_pending(runs: DataFrame, ledger: DataFrame, limit: int = 0) -> DataFrame:
    """Failed runs that were debited and not refunded, those that ended first first."""
    due = runs.where("status = 'failed' AND credit_cost > 0")
    due = due.join(ledger.where("reason = 'debit'").select(F.col("run_id").alias("id")), "id", "left_semi")
    due = due.join(ledger.where("reason = 'refund'").select(F.col("run_id").alias("id")), "id", "left_anti")
    out = due.orderBy(F.asc_nulls_last("completed_at"), "id")
    return out.limit(limit) if limit else out


def refund_candidates(runs: DataFrame) -> DataFrame:
    """Failed runs that cost something, whether or not they were debited: for stores that keep no ledger of debits."""
    return runs.where("status = 'failed' AND credit_cost > 0")


def refunded(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    on = (F.col("r.org_id").eqNullSafe(F.col("l.org_id"))) & (F.col("r.id") == F.col("l.run_id"))
    return runs.alias("r").join(ledger.where("reason = 'refund'").alias("l"), on, "left_semi")


# outboxes: triggers and webhooks


def pending(outbox: DataFrame, limit: int = 10) -> DataFrame:
    return outbox.where("status = 'pending'").orderBy("created_at", "id").limit(limit)


def to_processing(outbox: DataFrame, ident: Column) -> DataFrame:
    return changed(outbox, ident & (F.col("status") == "pending"), status="processing")


def finished(outbox: DataFrame, ident: Column, status: str, at: str, now, **to) -> DataFrame:
    return changed(outbox, ident, status=status, **{at: F.lit(now)}, **to)


def failed_attempt(outbox: DataFrame, ident: Column, error: str, column: str = "error_message", max_attempts: int = 5) -> DataFrame:
    """One attempt more, pending again; failed once there were as many as may be."""
    again = F.when(F.col("attempts") + 1 >= max_attempts, "failed").otherwise("pending")
    return changed(outbox, ident, status=again, attempts=F.col("attempts") + 1, **{column: error})


def webhook_attempt(outbox: DataFrame, ident: Column, error: str) -> DataFrame:
    """One attempt more and the error; the status stays, as deliveries in progress aren't pending."""
    return changed(outbox, ident, attempts=F.col("attempts") + 1, last_error=error)


FINISHED = ("completed", "failed")


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The runs whose status has changed, as they are after, with the status before (NULL of a new run)."""
    old = before.select("id", F.col("status").alias("_was"))
    return after.join(old, "id", "left").where(~F.col("status").eqNullSafe(F.col("_was"))).withColumnRenamed("_was", "was")


def lifecycle_events(changed_: DataFrame, now) -> DataFrame:
    """An event for each run that has begun or come to its end."""
    kind = F.concat(F.lit("run."), F.col("status"))
    return changed_.where(F.col("status").isin("running", *FINISHED)).select(F.col("id").alias("run_id"), kind.alias("event_type"), "attempt", F.col("claimed_by").alias("worker_id"), F.lit(now).alias("created_at"))


def webhooks_due(changed_: DataFrame, now) -> DataFrame:
    """A pending webhook for each run that has come to an end, whichever, and has an address to call back."""
    ends = changed_.where(F.col("status").isin(*FINISHED) & (F.coalesce("callback_url", F.lit("")) != ""))
    payload = F.to_json(F.struct(F.col("id").alias("run_id"), "status"))
    return ends.select(
        F.concat(F.lit("hook-"), F.col("id"), F.lit("-"), F.col("status")).alias("id"), F.col("id").alias("run_id"), F.col("callback_url").alias("url"), F.concat(F.lit("run."), F.col("status")).alias("event_type"),
        payload.alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit("").alias("last_error"), F.lit(now).alias("created_at"),
    )


def triggers_due(changed_: DataFrame, specs: DataFrame, now) -> DataFrame:
    """A pending trigger for each follow-up, of specs (parent_run_id, child_spec), of a run that has completed."""
    done = changed_.where("status = 'completed'").select(F.col("id").alias("parent_run_id"))
    rows = specs.join(done, "parent_run_id")
    return rows.select(S.minted("trig_", F.col("parent_run_id"), F.col("child_spec")).alias("id"), "parent_run_id", "child_spec", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit("").alias("error_message"), F.lit(now).alias("created_at"))


def children_of(triggers: DataFrame, parents: DataFrame) -> DataFrame:
    """The runs that triggers in progress begin: their ids follow from the triggers', so that doing it twice does it once;
    organisation and project are their parents'."""
    p = parents.select(F.col("id").alias("parent_run_id"), "org_id")
    return triggers.where("status = 'processing'").join(p, "parent_run_id").select(F.regexp_replace("id", "^trig_", "run_").alias("id"), "parent_run_id", "org_id", F.col("child_spec").alias("definition_type"))


def numbered(events: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """events and a batch of new ones, whose seq goes on from the largest. A batch is what one writer appends at a time: its
    rows are numbered in one task."""
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("_last"))
    rows = new.withColumn("_r", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(last))  # one row
    return events.unionByName(rows.withColumn("seq", F.col("_last") + F.col("_r")).drop("_last", "_r"), allowMissingColumns=True)


def paused(branches: DataFrame, ident: Column, reason: str, now) -> DataFrame:
    """Branches marked as paused; of one that waits, the time that is left is kept instead of its end. One that is paused
    already stays as it is."""
    hit = ident & ~F.coalesce(F.col("paused"), F.lit(False))
    return changed(branches, hit, paused=True, pause_reason=reason, remaining=S.remaining(F.col("wake_at"), F.lit(now)), wake_at=F.lit(None))


def unpaused(branches: DataFrame, ident: Column, now) -> DataFrame:
    """The reverse: a wait has its time again, from now on."""
    hit = ident & F.coalesce(F.col("paused"), F.lit(False))
    return changed(branches, hit, paused=False, pause_reason="", wake_at=S.thawed(F.lit(now), F.col("remaining")), remaining=F.lit(None))


def unknown_keys(given: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The keys that were given but aren't known."""
    return given.select(key).join(known.select(key), key, "left_anti")


# progress, events


def latest_progress(progress: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. max_by over one struct: aggregated before the shuffle, unlike a window."""
    rest = [c for c in progress.columns if c not in keys]
    return progress.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def attempts(progress: DataFrame, keys: list[str], order: list[str], completed: Column) -> DataFrame:
    """attempt: 1, or one more than the row before of the key, unless that completed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = F.coalesce(F.sum(completed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return progress.withColumn("_run", run).withColumn("attempt", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))).drop("_run")


def progress_list(progress: DataFrame, execution_id) -> DataFrame:
    return progress.where(F.col("execution_id") == execution_id).orderBy(F.asc_nulls_last("started_at"), "step_name", "branch_id")


def sequenced(df: DataFrame, keys: list[str], order: list, name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def tail(events: DataFrame, run_id: Column, after: int) -> DataFrame:
    return events.where(run_id & (F.col("seq") > after)).orderBy("seq")


def retained(events: DataFrame, since) -> DataFrame:
    return events.where(F.col("created_at") >= F.lit(since))


# branches of executions


FINAL = {"failed": 4, "paused": 3, "suspended": 2, "completed": 1}
REASONS = {"paused": 3, "sleeping": 2, "waiting_signal": 1}


def ranked(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def final_status(branches: DataFrame, key: str, status: str = "status") -> DataFrame:
    return branches.groupBy(key).agg(F.max_by(status, ranked(F.col(status), FINAL)).alias("final_status"))


def buckets(branches: DataFrame, key: str, ident: str, status: str = "status", statuses: tuple = ("failed", "waiting", "suspended", "paused")) -> DataFrame:
    """The sorted identifiers of each status, an array a status."""
    return branches.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col(status) == s, F.col(ident)))).alias(s) for s in statuses))


def suspension(waits: DataFrame, key: str) -> DataFrame:
    """The earliest wake-up, the topics and the reason that counts, of each execution."""
    return waits.groupBy(key).agg(F.min("wake_at").alias("wake_at"), F.array_sort(F.collect_set("topic")).alias("topics"), F.max_by("reason", ranked(F.col("reason"), REASONS)).alias("reason"))


def ready_by_count(branches: DataFrame, key: str, k: int = 2, completed: Column | None = None) -> DataFrame:
    """(key, n) of executions of which at least k branches have completed."""
    n = F.count(F.lit(1)) if completed is None else F.count_if(completed)
    return branches.groupBy(key).agg(n.alias("n")).where(F.col("n") >= k)


def ready_by_name(branches: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key) of executions of which all these branches have completed."""
    done = branches.where((F.col("status") == "completed") & F.col("branch_id").isin(names))
    return done.groupBy(key).agg(F.count_distinct("branch_id").alias("n")).where(F.col("n") == len(set(names))).select(key)


# signals


def send(signals: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new signals after those that are there; none is lost, whether or not somebody waits for it."""
    return signals.unionByName(new, allowMissingColumns=True)


def receive(signals: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The oldest signal of each key, and the table without these."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    ranked_ = signals.withColumn("_first", first)
    return ranked_.where("_first").drop("_first"), ranked_.where("NOT _first").drop("_first")


def rendezvous(waits: DataFrame, signals: DataFrame, keys: list[str], wait_order: list[str], signal_order: list[str]) -> DataFrame:
    """Waits with the signals they get, first come first served: the k-th wait of a key gets the k-th signal."""
    w = sequenced(waits, keys, wait_order, "rn")
    s = sequenced(signals, keys, signal_order, "rn")
    return w.join(s, [*keys, "rn"])


def wait_outcome(waits: DataFrame, signals: DataFrame, keys: list[str], now) -> DataFrame:
    """outcome received, timeout or waiting: whether a signal of the key came by the deadline wake_at."""
    first = signals.groupBy(*keys).agg(F.min("ts").alias("_first"))
    out = F.when(F.col("_first") <= F.col("wake_at"), "received").when(F.col("wake_at") <= F.lit(now), "timeout").otherwise("waiting")
    return waits.join(first, keys, "left").withColumn("outcome", out).drop("_first")


def state_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, value): added, modified and deleted entries."""
    j = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")).join(after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y")), key, "full")
    change = F.when(F.col("_x").isNull(), "add").when(F.col("_y").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "modify")
    return j.withColumn("change", change).where("change IS NOT NULL").select(key, "change", F.col("_b").alias(value))


def patched(before: DataFrame, patches: DataFrame, key: str, value: str) -> DataFrame:
    kept = before.join(patches.select(key), key, "left_anti").select(key, value)
    return kept.unionByName(patches.where("change <> 'delete'").select(key, value))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
