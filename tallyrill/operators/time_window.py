"""Aggregates over time windows, with lateness judged arrival by arrival.

The watermark at an arrival is the greatest time seen so far, that row
included, less the lag; a row is dropped from each window that ends before it.
Rows that the condition rejects still move the watermark and open windows, whose
aggregates then have their initial values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Window, bounds
from .ordered import running


def placed(df: DataFrame, window: Window, ts: str) -> DataFrame:
    """Each row once for each window that covers its time: ``__ws``, its start.
    A slide beyond the length leaves gaps, rows in which vanish."""
    length, slide = bounds(window)
    t = F.col(f"`{ts}`")
    last = t - F.pmod(t, F.lit(slide).cast("long"))
    if length == slide:
        return df.withColumn("__ws", last)
    before = t - length
    first = before - F.pmod(before, F.lit(slide).cast("long")) + slide
    starts = F.when(first <= last, F.sequence(first, last, F.lit(slide).cast("long")))
    return df.withColumn("__ws", F.explode(starts))


def assigned(df: DataFrame, window: Window, ts: str, lag_ms: int, order: str, chunk_rows: int, seen: int | None = None) -> DataFrame:
    """Rows in their windows without those that come too late. ``seen``: the
    greatest time of earlier arrivals, if there are any."""
    length, _ = bounds(window)
    marked = running(df, order, {}, {"__seen": F.col(f"`{ts}`")}, chunk_rows)
    if seen is not None:
        marked = marked.withColumn("__seen", F.greatest("__seen", F.lit(seen).cast("long")))
    return placed(marked, window, ts).where(F.col("__ws") + length >= F.col("__seen") - lag_ms).drop("__seen")


def aggregated(rows: DataFrame, window: Window, where: Column, fields: dict[str, Column], key: str | None) -> DataFrame:
    """One row a window, or a window and key. ``fields`` are built with ``where``
    as their condition."""
    length, _ = bounds(window)
    ends = [F.col("__ws").alias("window_start_ms"), (F.col("__ws") + length).alias("window_end_ms")]
    made = {n: f"__a{i}" for i, n in enumerate(fields)}
    aggregates = [c.alias(made[n]) for n, c in fields.items()]
    named = [F.col(a).alias(n) for n, a in made.items()]
    if key is None:
        size = F.least(F.count(F.when(where, 1)), F.lit(1)).cast("long").alias("__size")
        return rows.groupBy("__ws").agg(*aggregates, size).select(*ends, *named, F.col("__size").alias("size"))
    out = rows.where(where).groupBy("__ws", F.col(f"`{key}`").cast("long").alias("__key")).agg(*aggregates)
    return out.select(*ends, F.col("__key").alias("key"), *named)
