"""The driver's side of a run: activities that may fail are retried and caught, runs are timed, bounded, recorded and
resumed."""

from __future__ import annotations

import json
import os
import random
import shutil
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession

from loomgraph.operators import runs as R
from loomgraph.plans.spec import Catch, Retry
from loomgraph.sources.files import Files

KEY = "exec_id"

COMPLETED, FAILED, SUSPENDED, PAUSED = "completed", "failed", "suspended", "paused"


class RunError(Exception):
    """An error of a type: activity_failed, timeout, fatal_error or one's own."""

    def __init__(self, kind: str, cause: str = "", details: Any = None):
        super().__init__(f"{kind}: {cause}")
        self.kind, self.cause, self.details = kind, cause, details

    def record(self) -> dict[str, Any]:
        return {"Error": self.kind, "Cause": self.cause, "Details": self.details}


class LeaseLost(Exception):
    """Another worker holds the run; never retried, never caught."""


def classify(e: BaseException) -> RunError:
    if isinstance(e, RunError):
        return e
    return RunError("timeout" if isinstance(e, TimeoutError) else "activity_failed", str(e))


def matches(e: BaseException, pattern: str) -> bool:
    if isinstance(e, LeaseLost):
        return False
    kind = classify(e).kind
    if kind == "fatal_error":
        return pattern == "fatal_error"
    if pattern == "all":
        return True
    return kind != "timeout" if pattern == "activity_failed" else kind == pattern


def find_policy(e: BaseException, policies: list) -> Any:
    return next((p for p in policies if any(matches(e, x) for x in p.errors or ["all"])), None)


def delay(attempt: int, r: Retry) -> float:
    out = r.base_delay * r.backoff_rate ** (attempt - 1)
    if r.max_delay > 0:
        out = min(out, r.max_delay)
    if out <= 0:
        return r.base_delay
    return random.uniform(0, out) if r.jitter else out


def bounded(spark: SparkSession | None, seconds: float, f: Callable[[], Any]) -> Any:
    """f's result; after so many seconds its Spark jobs are cancelled and TimeoutError is raised."""
    if not seconds:
        return f()
    over = threading.Event()
    tag = f"bounded-{time.monotonic_ns()}"

    def cancel() -> None:
        over.set()
        if spark is not None:
            spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    timer.start()
    if spark is not None:
        spark.sparkContext.addJobTag(tag)
    try:
        out = f()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"over {seconds} s") from e
        raise
    finally:
        timer.cancel()
        if spark is not None:
            spark.sparkContext.removeJobTag(tag)
    if over.is_set():
        raise TimeoutError(f"over {seconds} s")
    return out


def attempt(f: Callable[[], Any], retry: list[Retry] = (), catch: list[Catch] = (), spark: SparkSession | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, Catch | None, dict | None]:
    """(result, None, None); or (None, the handler that catches the error, the error's record). The first error decides
    which policy counts for all attempts; its timeout bounds each of them, the first with the smallest one of any."""
    policy, tries = None, 0
    limit = min((r.timeout for r in retry if r.timeout), default=0)
    while True:
        tries += 1
        try:
            return bounded(spark, policy.timeout if policy else limit, f), None, None
        except Exception as e:
            policy = policy or find_policy(e, list(retry))
            if policy and tries <= policy.max_retries and not isinstance(e, LeaseLost):
                sleep(delay(tries, policy))
                continue
            handler = find_policy(e, list(catch))
            if handler is None:
                raise classify(e) if not isinstance(e, LeaseLost) else e from None
            return None, handler, classify(e).record()


def attempted(f: Callable[[], Any], retry: list[Retry]) -> tuple[Any, str | None, str | None, int]:
    """(value, type of the error, its cause, attempts) of a call."""
    tries = 0

    def once() -> Any:
        nonlocal tries
        tries += 1
        return f()

    try:
        return attempt(once, retry)[0], None, None, tries
    except LeaseLost:
        raise
    except Exception as e:
        return None, classify(e).kind, classify(e).cause, tries


class Callbacks:
    """Before and after executions, branches and steps; a base to override."""

    def before(self, what: str, name: str) -> None: ...

    def after(self, what: str, name: str, seconds: float, error: BaseException | None) -> None: ...


class Chain(Callbacks):
    def __init__(self, *callbacks: Callbacks):
        self.callbacks = list(callbacks)

    def before(self, what, name):
        for c in self.callbacks:
            c.before(what, name)

    def after(self, what, name, seconds, error):
        for c in self.callbacks:
            c.after(what, name, seconds, error)


@dataclass
class Result:
    status: str
    outputs: dict[str, Any] = field(default_factory=dict)
    error: RunError | None = None
    seconds: float = 0.0
    reason: str = ""
    topics: list[str] = field(default_factory=list)
    wake_at: Any = None

    def completed(self) -> bool:
        return self.status == COMPLETED

    def failed(self) -> bool:
        return self.status == FAILED

    def suspended(self) -> bool:
        return self.status == SUSPENDED

    def paused(self) -> bool:
        return self.status == PAUSED

    def suspension(self) -> tuple[str, list[str], Any]:
        """The reason that counts, the topics, and the earliest time to wake up; empty if nothing waits."""
        return self.reason, self.topics, self.wake_at

    def needs_resume(self) -> bool:
        return self.status in (SUSPENDED, PAUSED)

    def string(self, key: str) -> tuple[str, bool]:
        v = self.outputs.get(key)
        return (v, True) if isinstance(v, str) else ("", False)

    def integer(self, key: str) -> tuple[int, bool]:
        v = self.outputs.get(key)
        return (int(v), True) if isinstance(v, int | float) and not isinstance(v, bool) else (0, False)

    def boolean(self, key: str) -> tuple[bool, bool]:
        v = self.outputs.get(key)
        return (v, True) if isinstance(v, bool) else (False, False)


class Materialised:
    """Steps of a run written as Parquet under a shared folder, so that a run that failed is resumed at the step that
    failed. A step counts as written only once its marker is there."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{run_id}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def done(self, step: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/{step}/_SUCCESS"))

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def delete(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)


class History:
    """Results by key, so that what a replay asks for again isn't done again; errors aren't kept."""

    def __init__(self, kept: dict[str, Any] | None = None):
        self.kept = kept if kept is not None else {}

    def record_or_replay(self, key: str, f: Callable[[], Any]) -> Any:
        if key not in self.kept:
            self.kept[key] = f()
        return self.kept[key]


class Runner:
    """Runs steps in order, each materialised; follow-ups come after success only."""

    def __init__(self, spark: SparkSession, folder: str, callbacks: Callbacks | None = None, timeout: float = 0.0, heartbeat: Callable[[], bool] | None = None, heartbeat_seconds: float = 30.0, on_complete: Callable[[Result], list] | None = None):
        self.spark, self.folder, self.callbacks = spark, folder, callbacks or Callbacks()
        self.timeout, self.heartbeat, self.every, self.on_complete = timeout, heartbeat, heartbeat_seconds, on_complete
        self.follow_ups: list = []

    def run(self, run_id: str, steps: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]) -> Result:
        began, store, done = time.monotonic(), Materialised(self.spark, self.folder, run_id), {}
        stop, lost = threading.Event(), threading.Event()

        def beat() -> None:
            while not stop.wait(self.every):
                if not self.heartbeat():
                    lost.set()
                    return

        if self.heartbeat:
            threading.Thread(target=beat, daemon=True).start()
        try:
            for name, make in steps:
                if lost.is_set():
                    raise LeaseLost(run_id)
                self.callbacks.before("step", name)
                at, error = time.monotonic(), None
                try:
                    done[name] = bounded(self.spark, self.timeout, lambda name=name, make=make: store.step(name, lambda: make(done)))
                except Exception as e:
                    error = e
                    raise
                finally:
                    self.callbacks.after("step", name, time.monotonic() - at, error)
            out = Result(COMPLETED, done, None, time.monotonic() - began)
        except Exception as e:
            out = Result(FAILED, {}, classify(e), time.monotonic() - began)
        finally:
            stop.set()
        if out.completed() and self.on_complete:
            self.follow_ups += self.on_complete(out)
        return out


def collect(compiled: Any) -> list[Result]:
    """A result for each execution of a compiled definition, for few executions: they are brought to the driver. Of one that
    waits, the reason that counts, the topics and the earliest wake-up."""
    began = time.monotonic()
    names = [o.name for o in compiled.definition.outputs]
    waits = R.suspension(compiled.suspended, KEY) if compiled.suspended is not None else None
    rows = compiled.executions if waits is None else compiled.executions.join(waits.select(KEY, "wake_at", "topics", "reason"), KEY, "left")
    out = []
    for r in rows.collect():
        error = RunError(r["error"]["Error"], r["error"]["Cause"]) if r["error"] else None
        done = r["status"] == COMPLETED
        out.append(Result(r["status"], {n: r[n] for n in names} if done else {}, error, time.monotonic() - began, (not done and r["reason"]) or "", list((not done and r["topics"]) or ()), None if done else r["wake_at"]))
    return out


class Detached:
    """Children that run beside their parent, in threads of the driver: start() gives a handle at once, result() what it came
    to. Results are kept for a while (an hour) after they came, in memory: a new driver doesn't know them."""

    def __init__(self, at_once: int = 4, kept_seconds: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.pool, self.kept_seconds, self.clock = ThreadPoolExecutor(at_once), kept_seconds, clock
        self.jobs: dict[str, Future] = {}
        self.ended: dict[str, float] = {}

    def start(self, f: Callable[[], Any]) -> str:
        self._forget()
        handle = uuid.uuid4().hex
        self.jobs[handle] = job = self.pool.submit(f)
        job.add_done_callback(lambda _: self.ended.__setitem__(handle, self.clock()))
        return handle

    def done(self, handle: str) -> bool:
        self._forget()
        return self._job(handle).done()

    def result(self, handle: str, seconds: float | None = None) -> Any:
        """What it came to, waiting so long at most; its error is raised."""
        self._forget()
        return self._job(handle).result(seconds)

    def _job(self, handle: str) -> Future:
        if handle not in self.jobs:
            raise LookupError(f"no child {handle!r}")
        return self.jobs[handle]

    def _forget(self) -> None:
        for h in [h for h, t in self.ended.items() if self.clock() - t > self.kept_seconds]:
            del self.ended[h], self.jobs[h]


class ProgressTracker(Callbacks):
    """Rows of step progress, from callbacks and from reports of activities; sink, if any, is given each as it comes, and a
    sink that fails is left out."""

    def __init__(self, execution_id: str, sink: Callable[[dict], None] | None = None):
        self.execution_id, self.sink = execution_id, sink
        self.rows: list[dict[str, Any]] = []
        self.last: dict[str, dict[str, Any]] = {}

    def _add(self, step: str, **to: Any) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = {"execution_id": self.execution_id, "step_name": step, "branch_id": "main", "status": "running", "attempt": 1, "detail": None, "started_at": now, "finished_at": None, "error": "", **self.last.get(step, {}), **to, "updated_at": now}
        self.last[step] = row
        self.rows.append(row)
        if self.sink:
            try:
                self.sink(row)
            except Exception:  # what is told about a run doesn't change it
                pass

    def before(self, what: str, name: str) -> None:
        if what != "step":
            return
        old = self.last.pop(name, None)
        self._add(name, attempt=old["attempt"] + 1 if old and old["status"] != COMPLETED else 1)

    def after(self, what: str, name: str, seconds: float, error: BaseException | None) -> None:
        if what == "step":
            self._add(name, status=FAILED if error else COMPLETED, error=str(error or ""), finished_at=datetime.now(timezone.utc).replace(tzinfo=None))

    def report(self, step: str, message: str, data: dict[str, str] | None = None) -> None:
        """What an activity says of how far it is."""
        self._add(step, detail={"Message": message, "Data": data or {}})

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = "execution_id string, step_name string, branch_id string, status string, attempt int, detail struct<Message:string,Data:map<string,string>>, started_at timestamp, finished_at timestamp, error string, updated_at timestamp"
        return spark.createDataFrame([Row(**r) for r in self.rows], schema) if self.rows else spark.createDataFrame([], schema)


@dataclass
class WorkerConfig:
    """A worker's limits, in seconds where not said otherwise. What contradicts itself is an error."""

    concurrency: int = 10
    claim_every: float = 5.0
    heartbeat_every: float = 30.0
    stale_after: float = 120.0
    reap_every: float = 60.0
    max_attempts: int = 3
    run_timeout: float = 1800.0
    webhooks: bool = False
    deliver: Callable[[dict], None] | None = None

    def __post_init__(self) -> None:
        problems = [f"{k} must be positive" for k in ("concurrency", "claim_every", "heartbeat_every", "stale_after", "reap_every", "max_attempts", "run_timeout") if not getattr(self, k) > 0]
        if self.stale_after <= self.heartbeat_every:
            problems.append("stale_after must be more than heartbeat_every, or runs that are alive are taken for dead")
        if self.webhooks and self.deliver is None:
            problems.append("webhooks need something that delivers them")
        if problems:
            raise ValueError("; ".join(problems))


class Checkpoints:
    """Snapshots of small driver state by run; a base to override."""

    VERSION = 1

    def save(self, run_id: str, state: dict[str, Any]) -> None: ...

    def load(self, run_id: str) -> dict[str, Any]:
        raise LookupError(f"no checkpoint of {run_id!r}")

    def delete(self, run_id: str) -> None: ...

    def list(self) -> list[str]:
        return []

    def pause(self, run_id: str, branch: str, reason: str = "", now: float | None = None) -> None:
        """Marks a branch of a stored run as paused; the rest of its wait is kept. Once more does nothing."""
        self._change(run_id, branch, True, reason, time.time() if now is None else now)

    def unpause(self, run_id: str, branch: str, now: float | None = None) -> None:
        self._change(run_id, branch, False, "", time.time() if now is None else now)

    def _change(self, run_id: str, branch: str, paused: bool, reason: str, now: float) -> None:
        state = self.load(run_id)
        b = state.get("branches", {}).get(branch)
        if b is None:
            raise LookupError(f"{run_id!r} has no branch {branch!r}")
        if b.get("paused", False) == paused:
            return
        b["paused"], b["pause_reason"] = paused, reason
        if paused and b.get("wake_at") is not None:
            b["remaining"], b["wake_at"] = max(b["wake_at"] - now, 0.0), None
        elif not paused and b.get("remaining") is not None:
            b["wake_at"], b["remaining"] = now + b["remaining"], None
        self.save(run_id, state)


class NoCheckpoints(Checkpoints):
    """Keeps nothing."""


class MemoryCheckpoints(Checkpoints):
    """Keeps copies, which later changes of what was saved don't reach."""

    def __init__(self) -> None:
        self.kept: dict[str, str] = {}

    def save(self, run_id, state):
        self.kept[run_id] = json.dumps(state)

    def load(self, run_id):
        if run_id not in self.kept:
            raise LookupError(f"no checkpoint of {run_id!r}")
        return json.loads(self.kept[run_id])

    def delete(self, run_id):
        self.kept.pop(run_id, None)

    def list(self):
        return sorted(self.kept)

    def snapshot(self) -> dict[str, dict[str, Any]]:
        """All that is kept, for tests."""
        return {k: json.loads(v) for k, v in self.kept.items()}


class Fenced(Checkpoints):
    """Saves only while a lease holds: held() is asked before each."""

    def __init__(self, inner: Checkpoints, held: Callable[[], bool]):
        self.inner, self.held = inner, held
        self.load, self.delete, self.list = inner.load, inner.delete, inner.list

    def save(self, run_id, state):
        if not self.held():
            raise LeaseLost(run_id)
        self.inner.save(run_id, state)


@dataclass(frozen=True)
class Claim:
    """A run that a worker holds; stores that are made of it write under its lease."""

    run_id: str
    worker: str
    attempt: int

    def checkpoints(self, inner: Checkpoints, held: Callable[[Claim], bool]) -> Fenced:
        return Fenced(inner, lambda: held(self))

    def progress(self, sink: Callable[[dict], None] | None = None) -> ProgressTracker:
        return ProgressTracker(self.run_id, sink)

    def lease(self) -> Column:
        return R.fence(self.run_id, self.worker, self.attempt, running=True)


class FileCheckpoints(Checkpoints):
    """Snapshots as JSON, each written whole and then renamed, in a folder of any of Hadoop's file systems, or, without a
    session, of this machine; a version that is unknown is refused. For state of tables, see Materialised."""

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.folder, self.files = folder.rstrip("/"), Files(spark) if spark else None

    def _names(self, path: str) -> list[str]:
        try:
            return [n.rstrip("/") for n in self.files.list(path)] if self.files else os.listdir(path)
        except (OSError, Py4JJavaError):  # it isn't there
            return []

    def _numbers(self, run_id: str) -> list[int]:
        return sorted(int(f[11:-5]) for f in self._names(f"{self.folder}/{run_id}") if f.startswith("checkpoint-") and f.endswith(".json"))

    def save(self, run_id, state):
        n = max(self._numbers(run_id), default=0) + 1
        part, at = f"{self.folder}/{run_id}/.part", f"{self.folder}/{run_id}/checkpoint-{n}.json"
        text = json.dumps({"schema_version": self.VERSION, "number": n, "state": state})
        if self.files:
            self.files.write(part, text, mkdirs=True)
            self.files.rename(part, at)
            return
        os.makedirs(f"{self.folder}/{run_id}", exist_ok=True)
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, at)

    def load(self, run_id):
        numbers = self._numbers(run_id)
        if not numbers:
            raise LookupError(f"no checkpoint of {run_id!r}")
        at = f"{self.folder}/{run_id}/checkpoint-{numbers[-1]}.json"
        got = json.loads(self.files.read(at) if self.files else Path(at).read_text(encoding="utf-8"))
        if not 1 <= got.get("schema_version", 0) <= self.VERSION:
            raise ValueError(f"checkpoint version {got.get('schema_version')} is unknown")
        return got["state"]

    def delete(self, run_id):
        if self.files:
            self.files.delete_all(f"{self.folder}/{run_id}")
        else:
            shutil.rmtree(f"{self.folder}/{run_id}", ignore_errors=True)

    def list(self):
        return sorted(self._names(self.folder))

    def summaries(self) -> list[dict[str, Any]]:
        """(id, status, start, duration in seconds) of each run's newest snapshot, as far as its state tells, newest first."""
        out = []
        for run_id in self.list():
            state = self.load(run_id)
            start, end = state.get("start"), state.get("end") or state.get("checkpoint_at")
            out.append({"id": run_id, "status": state.get("status", ""), "start": start, "seconds": end - start if start is not None and end is not None else None})
        return sorted(out, key=lambda r: (r["start"] is None, -(r["start"] or 0), r["id"]))
