"""A worker's loops on the driver: it claims runs up to its limit, runs each under its lease, and tells how they ended.

What it does to tables is handed in as functions, for which operators.runs has the changes; so a store may be files, a
table format or a database.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from loomgraph.plans.runner import COMPLETED, FAILED, Claim, LeaseLost, Result, WorkerConfig, bounded, classify
from loomgraph.streaming.durable import Wake


def _nothing(*_: Any) -> None: ...


@dataclass
class Store:
    """claim: up to so many runs. beat: whether the lease still holds, refreshing it. finish: writes a result under the
    lease, and says whether it held. debit, event and refund: the ledger and the log of events."""

    claim: Callable[[int], list[Claim]]
    beat: Callable[[Claim], bool]
    finish: Callable[[Claim, Result], bool]
    debit: Callable[[Claim], None] = _nothing
    event: Callable[[Claim, str], None] = _nothing
    refund: Callable[[Claim], None] = _nothing


class Worker:
    def __init__(self, store: Store, handler: Callable[[Claim], Result], config: WorkerConfig | None = None, spark: SparkSession | None = None):
        self.store, self.handler, self.config, self.spark = store, handler, config or WorkerConfig(), spark
        self.wake, self.stop = Wake(), threading.Event()
        self.running: dict[str, Claim] = {}
        self.errors: list[Exception] = []
        self._lock = threading.Lock()

    def execute(self, claim: Claim) -> Result | None:
        """Runs one claim: it is debited and its begin told, the lease is kept alive, the handler is bounded in time, and
        whatever comes of it, an error too, is written if the lease still holds. None if it doesn't. A run that failed is
        refunded. That the ledger or the log can't be written doesn't keep a run from running."""
        self._told(self.store.debit, claim)
        self._told(self.store.event, claim, "run.running")
        done, lost = threading.Event(), threading.Event()

        def beat() -> None:
            while not done.wait(self.config.heartbeat_every):
                if not self.store.beat(claim):
                    lost.set()
                    return

        threading.Thread(target=beat, daemon=True).start()
        try:
            result = bounded(self.spark, self.config.run_timeout, lambda: self.handler(claim))
        except LeaseLost:
            lost.set()
        except Exception as e:
            result = Result(FAILED, {}, classify(e))
        finally:
            done.set()
        if lost.is_set() or not self.store.finish(claim, result):
            return None
        self._told(self.store.event, claim, f"run.{result.status}")
        if result.status == FAILED:
            self._told(self.store.refund, claim)
        return result

    def _told(self, f: Callable, *args: Any) -> None:
        try:
            f(*args)
        except Exception as e:
            self.errors.append(e)

    def _run(self, claim: Claim) -> None:
        try:
            self.execute(claim)
        except Exception as e:
            self.errors.append(e)
        finally:
            with self._lock:
                del self.running[claim.run_id]
            self.wake.notify()

    def loop(self) -> None:
        """Claims as many runs as there is room for, again whenever one has ended, or it is woken, or after a while; until it
        is to stop, and then until what runs has ended."""
        with ThreadPoolExecutor(self.config.concurrency) as pool:
            while not self.stop.is_set():
                room = self.config.concurrency - len(self.running)
                try:
                    claims = self.store.claim(room) if room else []
                except Exception as e:
                    self.errors.append(e)
                    claims = []
                for c in claims:
                    with self._lock:
                        self.running[c.run_id] = c
                    pool.submit(self._run, c)
                if len(claims) < room or not room:
                    self.wake.wait(self.config.claim_every)


def completed(**outputs: Any) -> Result:
    return Result(COMPLETED, outputs)
