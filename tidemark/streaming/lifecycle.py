"""Halting, draining, starting and stopping a stream; idempotent commit and dead-letter sinks."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("tidemark")


class Breaker:
    """A latch: the first trip gives the reason and runs the actions once; later ones change nothing."""

    def __init__(self) -> None:
        self._lock, self._event, self.reason, self._actions = threading.RLock(), threading.Event(), None, []

    def on_trip(self, action: Callable[[str], None]) -> None:
        with self._lock:
            self._actions.append(action)

    def trip(self, reason: str | None = None) -> bool:
        with self._lock:
            if self._event.is_set():
                return False
            self.reason = reason or "unknown reason"
            self._event.set()
            actions = list(self._actions)
        for a in actions:
            a(self.reason)
        return True

    @property
    def tripped(self) -> bool:
        return self._event.is_set()


class Once:
    """A callback that runs once, whoever asks first."""

    def __init__(self, callback: Callable[[str | None], None]) -> None:
        self._callback, self._lock, self._done = callback, threading.Lock(), False

    def __call__(self, reason: str | None = None) -> bool:
        with self._lock:
            if self._done:
                return False
            self._done = True
        self._callback(reason)
        return True


class Consumer:
    """Starts a stream, waits for its first progress, drains it within a time, stops it in order."""

    def __init__(self, start: Callable[[], object], config, on_shutdown: Callable[[str | None], None] | None = None) -> None:
        self._start, self.config, self.breaker, self.query = start, config, Breaker(), None
        self._shutdown = Once(on_shutdown or (lambda reason: log.info("stopped: %s", reason)))
        self.breaker.on_trip(lambda reason: self.emergency(reason))

    def subscribe(self):
        if self.breaker.tripped:
            raise RuntimeError(f"halted: {self.breaker.reason}")
        self.query = self._start()
        until = time.monotonic() + self.config.await_assignments_timeout
        while self.query.isActive and self.query.lastProgress is None:
            if time.monotonic() > until:
                self.query.stop()
                raise TimeoutError("no progress before the start timeout")
            time.sleep(0.05)
        return self.query

    def drain(self) -> bool:
        """Whether all available input was processed within the drain timeout; if not, the breaker trips."""
        done = threading.Event()

        def wait() -> None:
            try:
                self.query.processAllAvailable()
                done.set()
            except Exception as e:
                log.error("drain: %s", e)

        threading.Thread(target=wait, daemon=True).start()
        if not done.wait(self.config.drain_timeout):
            self.breaker.trip("drain timeout")
            return False
        return True

    def shutdown(self) -> None:
        if self.query is not None and self.query.isActive:
            self.drain()
            self.query.stop()
        self._shutdown(self.breaker.reason)

    def emergency(self, reason: str) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self._shutdown(reason)


def merged_commits(old: DataFrame, new: DataFrame) -> DataFrame:
    """The commit table after a batch: each partition's highest offset, so replays and late batches change nothing."""
    return old.unionByName(new).groupBy("partition").agg(F.max("offset").alias("offset"))


def split(batch: DataFrame, dead_letter: Callable[[DataFrame], None], commit: Callable[[DataFrame], None]) -> None:
    """A foreachBatch body: dead letters first, then commits; a failed dead letter or a halt commits nothing."""
    from tidemark.operators.outcomes import Halted

    batch = batch.persist()
    try:
        dead_letter(batch.where("status = 'dead_letter'").dropDuplicates(["partition", "offset"]))
        if not batch.where("status = 'halt'").isEmpty():
            raise Halted("a dead letter could not be written")
        commit(batch.where("status <> 'halt'").groupBy("partition").agg(F.max("offset").alias("offset")))
    finally:
        batch.unpersist()
