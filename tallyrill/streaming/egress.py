"""Delivery of results to callbacks: at once, or by a watched consumer thread."""

from __future__ import annotations

import logging
import queue
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame

log = logging.getLogger("tallyrill")

TICK_S = 0.02


class Delivery(Enum):
    SYNC = "sync"
    ASYNC = "async"


class Policy(Enum):
    """What happens when a callback takes longer than the threshold: DRAIN
    discards the backlog, FAILOVER puts a new consumer in place (and drains at
    the second hang in a row), ALERT_ONLY tells the listener."""

    DRAIN = 1
    FAILOVER = 2
    ALERT_ONLY = 3


@dataclass(frozen=True)
class Alert:
    elapsed_ms: int
    pending: int
    dropped: int
    policy: int


class Egress:
    """A queue of results for callbacks."""

    def __init__(self, delivery: Delivery = Delivery.SYNC, policy: Policy = Policy.ALERT_ONLY, threshold_ms: int = 100):
        self.delivery, self.alerts, self.dropped, self.generation = delivery, 0, 0, 0
        self.set_policy(policy, threshold_ms)
        self.listener: Callable[[Alert], None] | None = None
        self._queue: queue.Queue = queue.Queue()
        self._lock, self._busy_since, self._hangs, self._stopped = threading.Lock(), None, 0, threading.Event()
        self._alerted, self._more = False, threading.Event()
        self._watch: threading.Thread | None = None

    def set_policy(self, policy: Policy, threshold_ms: int) -> None:
        self.policy, self.threshold_ms = policy, max(1, threshold_ms)

    def set_alert_listener(self, listener: Callable[[Alert], None] | None) -> None:
        self.listener = listener

    @property
    def pending(self) -> int:
        return self._queue.qsize()

    def deliver(self, callback: Callable, *args) -> None:
        if self.delivery is Delivery.SYNC:
            callback(*args)
            return
        if self._watch is None:
            self._start_consumer()
            self._watch = threading.Thread(target=self._guard, daemon=True)
            self._watch.start()
        self._queue.put((callback, args))
        self._more.set()

    def deliver_rows(self, callback: Callable[[list], None], df: DataFrame) -> None:
        """The rows of a bounded result (a rule's LIMIT) to a callback."""
        self.deliver(callback, df.collect())

    def for_each_batch(self, callback: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A function for ``writeStream.foreachBatch``."""
        return lambda df, batch_id: self.deliver(callback, df, batch_id)

    def _start_consumer(self) -> None:
        self.generation += 1
        threading.Thread(target=self._consume, args=(self.generation,), daemon=True).start()

    def _consume(self, generation: int) -> None:
        while not self._stopped.is_set() and generation == self.generation:
            try:
                with self._lock:  # what has left the queue is being worked on
                    callback, args = self._queue.get_nowait()
                    self._busy_since, self._alerted = time.monotonic(), False
            except queue.Empty:
                self._more.wait(TICK_S)
                self._more.clear()
                continue
            try:
                callback(*args)
            except Exception:
                log.exception("a callback failed")
            with self._lock:
                if generation == self.generation:
                    if self._busy_since and (time.monotonic() - self._busy_since) * 1000 < self.threshold_ms:
                        self._hangs = 0
                    self._busy_since = None

    def _drain(self) -> None:
        while True:
            try:
                self._queue.get_nowait()
                self.dropped += 1
            except queue.Empty:
                return

    def _guard(self) -> None:
        while not self._stopped.wait(TICK_S):
            with self._lock:
                since, alerted = self._busy_since, self._alerted
                elapsed = int((time.monotonic() - since) * 1000) if since else 0
                if not since or alerted or elapsed < self.threshold_ms:
                    continue
                self._alerted, self.alerts, self._hangs = True, self.alerts + 1, self._hangs + 1
                if self.policy is Policy.DRAIN or self.policy is Policy.FAILOVER and self._hangs > 1:
                    self._drain()
                if self.policy is Policy.FAILOVER and self._hangs == 1:
                    self._busy_since = None
                    self._start_consumer()
            if self.listener:
                try:
                    self.listener(Alert(elapsed, self.pending, self.dropped, self.policy.value))
                except Exception:
                    log.exception("an alert listener failed")

    def flush(self, timeout_s: float = 10) -> bool:
        """Wait until the queue is empty and no callback runs."""
        end = time.monotonic() + timeout_s
        while time.monotonic() < end:
            with self._lock:
                if not self.pending and self._busy_since is None:
                    return True
            time.sleep(TICK_S / 4)
        return False

    def stop(self) -> None:
        self._stopped.set()
