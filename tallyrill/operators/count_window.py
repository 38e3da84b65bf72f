"""Rules over the latest rows of a record.

Snapshot: the rows that a rule selects after the last arrival. Trace: those that
it selects after each arrival. Names of the ``__`` namespace are used throughout:
``__arrival`` (after which arrival) and ``__row`` (place in delivery, from 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running


def latest(df: DataFrame, order: str, window_rows: int) -> DataFrame:
    """The ``window_rows`` latest arrivals. Their least order number comes from
    that column alone; the other columns are read from there on."""
    newest = df.select(order).orderBy(F.col(order).desc()).limit(window_rows)
    return df.where(F.col(order) >= newest.agg(F.min(order)).scalar())


def snapshot(rows: DataFrame, order: str, where: Column, limit: int) -> DataFrame:
    """Of ``latest`` rows those selected, numbered in delivery order: newest
    first for a limit of 0 or more, else oldest first."""
    way = F.col(order).desc() if limit >= 0 else F.col(order).asc()
    picked = rows.where(where).orderBy(way).limit(abs(limit))
    # ``latest`` has a bounded number of rows: they are numbered in one task
    return picked.withColumn("__row", (F.row_number().over(W.orderBy(way)) - 1).cast("long"))


def trace(df: DataFrame, order: str, where: Column, limit: int, window_rows: int, chunk_rows: int) -> DataFrame:
    """Rows of ``df`` for each arrival that selects any.

    Each match has an ordinal. The newest ``n`` matches up to an arrival are the
    ordinals up to its own count of matches, less those whose place among the
    arrivals has left the window; the oldest ones begin after the count of
    matches up to ``window_rows`` arrivals before."""
    n = min(abs(limit), window_rows)
    m = df.withColumn("__m", F.when(where, 1).otherwise(0).cast("long"))
    m = running(m, order, {"__rn": F.lit(1).cast("long"), "__mm": F.col("__m")}, {}, chunk_rows)
    matches = m.where("__m = 1").select(*[F.col(f"`{c}`") for c in df.columns], F.col("__mm").alias("__k"), F.col("__rn").alias("__place"))
    arrival = F.col(order).alias("__arrival")
    if limit >= 0:
        ends = m.where("__mm > 0").select(arrival, "__rn", F.col("__mm").alias("__hi")).where(F.lit(n > 0))
        spread = ends.select("__arrival", "__rn", "__hi", F.explode(F.sequence(F.greatest(F.col("__hi") - (n - 1), F.lit(1)), F.col("__hi"))).alias("__k"))
        picked = spread.join(matches, "__k").where(F.col("__place") > F.col("__rn") - window_rows)
        return picked.withColumn("__row", F.col("__hi") - F.col("__k")).drop("__k", "__hi", "__rn", "__place")
    ranges = _gone(m, ["__mm"], window_rows).select(F.col("__order").alias("__arrival"), (F.col("__gone_0") + 1).alias("__lo"), F.least(F.col("__gone_0") + n, F.col("__mm")).alias("__hi"))
    spread = ranges.where("__lo <= __hi").select("__arrival", "__lo", F.explode(F.sequence("__lo", "__hi")).alias("__k"))
    return spread.join(matches, "__k").withColumn("__row", F.col("__k") - F.col("__lo")).drop("__k", "__lo", "__place")


def _gone(m: DataFrame, counts: list[str], window_rows: int, order: str = "__seq") -> DataFrame:
    """``__order``, the columns ``counts``, and what they were ``window_rows``
    arrivals before (``__gone_0``, ...)."""
    names = [f"__gone_{i}" for i in range(len(counts))]
    left = m.select((F.col("__rn") + window_rows).alias("__rn"), *[F.col(c).alias(g) for c, g in zip(counts, names)])
    out = m.select(F.col(order).alias("__order"), "__rn", *counts).join(left, "__rn", "left")
    return out.select("__order", *counts, *[F.coalesce(g, F.lit(0)).alias(g) for g in names])


def sizes(df: DataFrame, order: str, rules: list[tuple[Column, int]], window_rows: int, chunk_rows: int) -> DataFrame:
    """``__arrival`` and, for each rule (condition, limit), how many rows it
    delivers then: ``__size_0``, ... All rules share one pass."""
    m = df.select(order, *[F.when(where, 1).otherwise(0).cast("long").alias(f"__m_{i}") for i, (where, _) in enumerate(rules)])
    counts = [f"__mm_{i}" for i in range(len(rules))]
    m = running(m, order, {"__rn": F.lit(1).cast("long")} | {c: F.col(f"__m_{i}") for i, c in enumerate(counts)}, {}, chunk_rows)
    found = _gone(m, counts, window_rows, order)
    size = [F.least(F.lit(min(abs(limit), window_rows)), F.col(c) - F.col(f"__gone_{i}")).cast("long").alias(f"__size_{i}") for i, (c, (_, limit)) in enumerate(zip(counts, rules))]
    return found.select(F.col("__order").alias("__arrival"), *size)
