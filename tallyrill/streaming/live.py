"""Rules with callbacks over arrivals as they come.

A micro-batch is worked on by the batch plans, with what they need of earlier
arrivals carried in: rules see the ``window_rows`` latest arrivals before it, and
windows the rows of those that are still open. Both are written beside the number
of the batch, so a repeated batch finds what it found before, and what lies behind
is deleted. Results are thus those of one run over all arrivals."""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.time_window import assigned
from ..types import bounds
from .egress import Egress

log = logging.getLogger("tallyrill")


class Carried:
    """Rows and a small value that pass from one micro-batch to the next: a folder
    ``<batch>-<turn>`` under ``path`` for each batch and each time the clock
    fires after it, of which the last two stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self.folder = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.under = lambda name: jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def left(self) -> list[tuple[int, int]]:
        """Batch and turn of all whole folders, in order."""
        if not self.fs.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)]
        return sorted(tuple(map(int, n.split("-"))) for n in names if self.fs.exists(self.under(f"{n}/value/_SUCCESS")))

    def before(self, batch: int) -> tuple[DataFrame | None, dict]:
        """What the last batch before ``batch`` left."""
        past = [x for x in self.left() if x[0] < batch]
        if not past:
            return None, {}
        at = "{}/{}-{}".format(self.path, *past[-1])
        return self.spark.read.parquet(f"{at}/rows"), json.loads(self.spark.read.text(f"{at}/value").first()[0])

    def leave(self, batch: int, rows: DataFrame, value: dict, turn: int = 0) -> None:
        at = f"{self.path}/{batch}-{turn}"
        rows.write.mode("overwrite").parquet(f"{at}/rows")
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/value")
        found = self.left()
        stale = [x for x in found if x < (batch, turn)][:-1] + [x for x in found if x > (batch, turn)]
        for old in stale:
            self.fs.delete(self.under("{}-{}".format(*old)), True)


@dataclass
class RowRule:
    """What a rule makes of arrivals: for each, the rows that it delivers."""

    trace: Callable[[DataFrame], DataFrame]
    callback: Callable[[list], None]


@dataclass
class LiveWindow:
    """A window aggregate, its rows of one micro-batch, and a callback for each window that closes."""

    passed: Callable[[DataFrame], DataFrame]
    rule: object
    callback: Callable[[object], None]
    lag_ms: int


class Live:
    """The rules of one record over a stream; a function for ``foreachBatch``.

    Row rules: for each arrival, in order, each callback gets its list of rows,
    which may be empty. Windows: a callback gets the row of a window once the
    watermark has passed its end or, if no batch came for ``idle_ms``, once the
    clock has. What a clock closed does not open again: later rows of it are
    late. Windows that are open at ``stop`` are not delivered; a stream that is
    started again on the same path goes on with them."""

    def __init__(self, spark: SparkSession, path: str, egress: Egress, rules: list[RowRule], windows: list[LiveWindow], window_rows: int, chunk_rows: int, idle_ms: int | None):
        self.spark, self.egress, self.rules, self.windows = spark, egress, rules, windows
        self.window_rows, self.chunk_rows, self.idle_ms = window_rows, chunk_rows, idle_ms
        self.tail = Carried(spark, f"{path.rstrip('/')}/tail")
        self.open = [Carried(spark, f"{path.rstrip('/')}/window-{i}") for i in range(len(windows))]
        self.lock, self.touched, self.stopped = threading.Lock(), time.monotonic(), threading.Event()
        if idle_ms is not None and windows:
            threading.Thread(target=self._watch, daemon=True).start()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with self.lock:
            batch = batch.persist()
            try:
                if self.rules:
                    self._rows(batch, batch_id)
                for w, carried in zip(self.windows, self.open):
                    self._window(w, carried, batch, batch_id)
            finally:
                batch.unpersist()
                self.touched = time.monotonic()

    def _rows(self, batch: DataFrame, batch_id: int) -> None:
        past, _ = self.tail.before(batch_id)
        seen = batch if past is None else past.unionByName(batch)
        out = batch.select(F.col("__seq").alias("__arrival"))
        for i, rule in enumerate(self.rules):
            rows = rule.trace(seen)
            fields = F.struct("__row", *[c for c in rows.columns if c not in ("__arrival", "__row")])
            some = rows.groupBy("__arrival").agg(F.sort_array(F.collect_list(fields)).alias(f"__r{i}"))  # a rule's LIMIT at most
            out = out.join(some, "__arrival", "left")
        for arrival in out.orderBy("__arrival").toLocalIterator():
            for i, rule in enumerate(self.rules):
                self.egress.deliver(rule.callback, [tuple(r)[1:] for r in arrival[f"__r{i}"] or []])
        self.tail.leave(batch_id, seen.orderBy(F.col("__seq").desc()).limit(self.window_rows), {})

    def _window(self, w: LiveWindow, carried: Carried, batch: DataFrame, batch_id: int) -> None:
        past, value = carried.before(batch_id)
        seen, closed = value.get("seen"), value.get("closed")
        length, _ = bounds(w.rule.window)
        rows = assigned(w.passed(batch), w.rule.window, w.rule.ts, w.lag_ms, "__seq", self.chunk_rows, seen)
        if closed is not None:  # by the clock
            rows = rows.where(F.col("__ws") + length > closed)
        rows = rows if past is None else past.unionByName(rows)
        top = batch.agg(F.max(w.rule.ts)).first()[0]
        seen = max((x for x in (seen, top) if x is not None), default=None)
        done = F.lit(False) if seen is None else F.col("__ws") + length < seen - w.lag_ms
        self._deliver(w, rows.where(done))
        carried.leave(batch_id, rows.where(~done), {"seen": seen, "closed": closed})

    def _deliver(self, w: LiveWindow, rows: DataFrame) -> None:
        order = ["window_start_ms"] + (["key"] if w.rule.key else [])
        for row in w.rule.result(rows).orderBy(*order).toLocalIterator():
            self.egress.deliver(w.callback, row)

    def fire(self, now_ms: int) -> None:
        """Close the windows whose end and lag the clock has passed."""
        with self.lock:
            for w, carried in zip(self.windows, self.open):
                left = carried.left()
                if not left:
                    continue
                (batch, turn), length = left[-1], bounds(w.rule.window)[0]
                rows, value = carried.before(batch + 1)
                closed = max(value.get("closed") or now_ms - w.lag_ms, now_ms - w.lag_ms)
                done = F.col("__ws") + length <= closed
                if rows.where(done).limit(1).count():
                    self._deliver(w, rows.where(done))
                    carried.leave(batch, rows.where(~done), value | {"closed": closed}, turn + 1)

    def _watch(self) -> None:
        while not self.stopped.wait(min(self.idle_ms, 1000) / 1000):
            if (time.monotonic() - self.touched) * 1000 >= self.idle_ms:
                try:
                    self.fire(int(time.time() * 1000))
                except Exception:
                    log.exception("firing by the clock failed")

    def stop(self) -> None:
        self.stopped.set()
