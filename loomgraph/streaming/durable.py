"""Durable operators on Structured Streaming: waits for signals with timers, sleeps, keyed upserts, idempotent appends,
outboxes, retention."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Columns, and folders, of tables that are divided and come in versions or batches.
PART, VERSION, BATCH = "part__", "version__", "batch__"
WAITS_OUT = "exec_id long, topic string, outcome string, payload string"


def signal_waits(events: DataFrame) -> DataFrame:
    """Outcomes of waits, from a stream of (exec_id, topic, kind, payload, ts, timeout_ms), kind being wait or signal.

    A signal that comes before its wait is kept and wins; each signal is used once, the oldest first. A wait with a
    timeout ends as "timeout" once the clock is past it; later signals stay for the next wait. A wait without one
    stays. State is a queue of payloads and one of deadlines for each (exec_id, topic).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        signals, waits = (list(x) for x in state.get) if state.exists else ([], [])
        out: list[tuple] = []
        now = state.getCurrentProcessingTimeMs()

        def expire() -> None:
            for d in [d for d in waits if 0 < d <= now]:
                waits.remove(d)
                out.append((*key, "timeout", None))

        if state.hasTimedOut:
            expire()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "kind"])
            for r in rows.itertuples():
                if r.kind == "signal":
                    signals.append(r.payload)
                else:
                    waits.append(now + int(r.timeout_ms) if r.timeout_ms and r.timeout_ms > 0 else 0)
            while signals and waits:
                waits.pop(0)
                out.append((*key, "received", signals.pop(0)))
            expire()
        if signals or waits:
            state.update((signals, waits))
            due = [d for d in waits if d > 0]
            if due:
                state.setTimeoutDuration(max(1, min(due) - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["exec_id", "topic", "outcome", "payload"])

    return events.groupBy("exec_id", "topic").applyInPandasWithState(step, WAITS_OUT, "signals array<string>, waits array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def due(waits: DataFrame, now=None) -> DataFrame:
    """Sleeps that are over."""
    return waits.where(F.col("wake_at") <= (F.current_timestamp() if now is None else F.lit(now)))


def upsert_progress(path: str, keys: list[str], order: list[str], parts: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body that keeps the last row of each key, in versions of a table that is divided by a hash of the key.
    A batch rewrites the parts that it has rows of, into a version of their own; a part's newest version counts, and
    progress_table() reads these. So a batch costs as much as the parts that it touches: choose parts by the size of the
    table, as they can't be changed later. A batch that was written already is left alone; older versions of a part than
    the last few are deleted."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{path}/done/{batch_id}"):
            return
        rows = batch.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r[PART] for r in rows.select(PART).distinct().collect()]  # as many as there are parts, at most
        newest = _newest(spark, path, batch_id)
        old = [f"{path}/{PART}={p}/{VERSION}={newest[p]}" for p in touched if p in newest]
        if old:
            before = spark.read.parquet(*old).withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
            rows = rows.unionByName(before)
        rest = [c for c in batch.columns if c not in keys]
        last = rows.groupBy(PART, *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(PART, *keys, "x.*")
        last.withColumn(VERSION, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART, VERSION).parquet(path)
        _touch(spark, f"{path}/done/{batch_id}")
        for p in touched:
            for v in sorted(_versions(spark, f"{path}/{PART}={p}"), reverse=True)[keep:]:
                delete(spark, f"{path}/{PART}={p}/{VERSION}={v}")

    return write


def progress_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table that upsert_progress() keeps; None before the first batch."""
    at = [f"{path}/{PART}={p}/{VERSION}={v}" for p, v in sorted(_newest(spark, path, None).items())]
    return spark.read.parquet(*at) if at else None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[len(VERSION) + 1 :]) for n in _names(spark, path) if n.startswith(f"{VERSION}=")]


def _newest(spark: SparkSession, path: str, before: int | None) -> dict[int, int]:
    """The newest version of each part that a whole batch has written, of batches before a number."""
    done = {int(n) for n in _names(spark, f"{path}/done") if n.isdigit()}
    found = {int(n[len(PART) + 1 :]): [v for v in _versions(spark, f"{path}/{n}") if v in done and (before is None or v < before)] for n in _names(spark, path) if n.startswith(f"{PART}=")}
    return {p: max(v) for p, v in found.items() if v}


def _touch(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_once(path: str, keys: list[str], parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body that appends the rows whose key isn't in the table yet; a batch that is repeated takes the
    place of what it wrote. The table is divided by a hash of the key, and only the parts that a batch has rows of are
    read, and of these only the keys."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys).withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        if any(n.startswith(f"{PART}=") for n in _names(spark, path)):
            touched = [r[PART] for r in rows.select(PART).distinct().collect()]  # as many as there are parts, at most
            old = spark.read.parquet(path).where(F.col(PART).isin(touched) & (F.col(BATCH) != batch_id))
            rows = rows.join(old.select(*keys, PART), [*keys, PART], "left_anti")
            for p in [n for n in _names(spark, path) if n.startswith(f"{PART}=")]:
                delete(spark, f"{path}/{p}/{BATCH}={batch_id}")
        rows.withColumn(BATCH, F.lit(batch_id)).write.mode("append").partitionBy(PART, BATCH).parquet(path)

    return write


def deliver(send: Callable[[dict], None], max_attempts: int = 5) -> Callable[[DataFrame], list[tuple]]:
    """A body for outboxes: delivers the pending rows of a small batch, and gives (id, status, attempts, error) of each;
    a failed delivery is pending again until there were as many attempts as may be."""

    def run(pending: DataFrame) -> list[tuple]:
        out = []
        for r in pending.toLocalIterator():
            try:
                send(r.asDict())
                out.append((r["id"], "delivered", r["attempts"] + 1, ""))
            except Exception as e:
                n = r["attempts"] + 1
                out.append((r["id"], "failed" if n >= max_attempts else "pending", n, str(e)))
        return out

    return run


def retain(spark: SparkSession, since, path: str) -> None:
    """Drops the rows before a time from a table: what stays is written beside it, and then takes its place by renaming, so
    that the table is whole at any time but between two renamings, and a stop there leaves its rows in path.new."""
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    fs, at = _fs(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(at) and exists(spark, f"{new}/_SUCCESS"):  # a renaming was cut short
        fs.rename(Path(new), at)
    spark.read.parquet(path).where(F.col("created_at") >= F.lit(since)).write.mode("overwrite").parquet(new)
    delete(spark, old)
    fs.rename(at, Path(old))
    fs.rename(Path(new), at)
    delete(spark, old)


def notify_loop(body: Callable[[], None], seconds: float, wake: Wake, stop: threading.Event) -> None:
    """Runs a body at once, and again after so many seconds, or sooner when woken, until it is to stop. An error of the body
    doesn't end the loop; it is kept in wake.errors."""
    while not stop.is_set():
        try:
            body()
        except Exception as e:
            wake.errors.append(e)
        wake.wait(seconds)


class Wake:
    """A nudge to a loop: it doesn't block, and several before the loop looks are one."""

    def __init__(self) -> None:
        self._event = threading.Event()
        self.errors: list[Exception] = []

    def notify(self) -> None:
        self._event.set()

    def wait(self, seconds: float) -> bool:
        woken = self._event.wait(seconds)
        self._event.clear()
        return woken


def reap_loop(round_: Callable[[], None], seconds: float = 60.0, wake: Wake | None = None) -> tuple[threading.Thread, threading.Event]:
    """A thread that runs rounds, of a reaper or of an outbox, and the event that ends it."""
    stop, wake = threading.Event(), wake or Wake()
    t = threading.Thread(target=notify_loop, args=(round_, seconds, wake, stop), daemon=True)
    t.start()
    return t, stop


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """An extension: counts by event-time window, with a watermark. ts is cast, for watermarks need a time zone."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
