"""Time-window aggregates over Structured Streaming sources.

``native`` uses Spark's own watermark, one millisecond longer than the lag since
Spark also drops a window whose end equals the watermark; lateness is judged
from one micro-batch to the next. ``ExactWindows`` judges it arrival by arrival:
each micro-batch is placed by the batch plan, with the greatest time of the
batches before carried in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.time_window import aggregated, assigned
from ..types import Window, bounds


def native(stream: DataFrame, window: Window, ts: str, lag_ms: int, where: Column, fields: dict[str, Column], key: str | None) -> DataFrame:
    """A streaming DataFrame for append or update mode. Slides beyond the length
    are for the batch plan and ``ExactWindows``."""
    length, slide = bounds(window)
    timed = stream.withColumn("__t", F.timestamp_millis(F.col(f"`{ts}`"))).withWatermark("__t", f"{lag_ms + 1} milliseconds")
    w = F.window("__t", f"{length} milliseconds", f"{slide} milliseconds")
    groups = [w.alias("w")] + ([F.col(f"`{key}`").cast("long").alias("key")] if key else [])
    rows = timed.where(where) if key else timed
    extra = [] if key else [F.least(F.count(F.when(where, 1)), F.lit(1)).cast("long").alias("size")]
    out = rows.groupBy(*groups).agg(*[c.alias(n) for n, c in fields.items()], *extra)
    names = (["key"] if key else []) + list(fields) + ([] if key else ["size"])
    return out.select(F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), *names)


class ExactWindows:
    """A ``foreachBatch`` sink. Rows that are in time are written by batch id to
    ``path`` (a repeated batch overwrites itself), and beside them the greatest
    time seen; ``result`` aggregates them."""

    def __init__(self, path: str, window: Window, ts: str, lag_ms: int, order: str, where: Column, fields: dict[str, Column], key: str | None = None, chunk_rows: int = 1 << 16):
        self.path, self.window, self.ts, self.lag_ms, self.order = path.rstrip("/"), window, ts, lag_ms, order
        self.where, self.fields, self.key, self.chunk_rows = where, fields, key, chunk_rows

    def _state(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.read.schema("batch long, state string").parquet(f"{self.path}/seen")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, None
        if batch_id:
            past = self._state(batch).where(F.col("batch") < batch_id).orderBy(F.col("batch").desc()).limit(1).collect()
            seen = json.loads(past[0]["state"])["seen"] if past else None
        rows = assigned(batch, self.window, self.ts, self.lag_ms, self.order, self.chunk_rows, seen)
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        top = batch.agg(F.max(f"`{self.ts}`")).first()[0]
        top = seen if top is None else top if seen is None else max(top, seen)
        state = spark.createDataFrame([(batch_id, json.dumps({"seen": top}))], "batch long, state string")
        state.write.mode("append").parquet(f"{self.path}/seen")

    def result(self, spark, closed_only: bool = False) -> DataFrame:
        """All windows, or those that the watermark has passed."""
        rows = spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        out = aggregated(rows, self.window, self.where, self.fields, self.key)
        if closed_only:
            seen = rows.sparkSession.read.parquet(f"{self.path}/seen").agg(F.max(F.get_json_object("state", "$.seen").cast("long"))).first()[0]
            out = out.where(F.col("window_end_ms") < F.lit(seen) - self.lag_ms)
        return out
