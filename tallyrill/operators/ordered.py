"""Running sums and maxima in arrival order, without a window over all rows.

Arrivals are cut into chunks, equal ranges of their order numbers and as many as
the number of rows calls for; within a chunk a window runs in its own task, and
what the chunks before add up to comes from a table with one row a chunk, of
which there are ``CHUNKS`` at most. Sparse order numbers cost no more than dense
ones; a burst makes a chunk longer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = 1 << 16


def chunk_of(df: DataFrame, order: str, chunk_rows: int) -> Column:
    """The chunk of a row: a function of its order number that never falls, from
    the least and greatest number and the count, one narrow scan."""
    n = F.count(F.lit(1))
    many = F.least(F.lit(float(CHUNKS)), F.greatest(F.lit(1.0), F.ceil(n / chunk_rows).cast("double")))
    low, high = F.min(order).cast("double"), F.max(order).cast("double")
    shape = df.agg(F.struct(low.alias("low"), ((high - low + 1) / many).alias("width")).alias("shape")).scalar()
    return F.floor((F.col(order).cast("double") - shape["low"]) / shape["width"])


def running(df: DataFrame, order: str, sums: dict[str, Column], maxima: dict[str, Column], chunk_rows: int) -> DataFrame:
    """``df`` with running (inclusive) sums and maxima in the order of ``order``,
    a unique whole number. Each entry names an output column."""
    base = df.withColumn("__chunk", chunk_of(df, order, chunk_rows))
    for name, c in (sums | maxima).items():
        base = base.withColumn(f"__v_{name}", c)
    local = Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # CHUNKS rows at most
    totals = base.groupBy("__chunk").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums], *[F.max(f"__v_{n}").alias(f"__t_{n}") for n in maxima])
    offsets = totals.select("__chunk", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums], *[F.max(f"__t_{n}").over(before).alias(f"__o_{n}") for n in maxima])
    out = base
    for n in sums:
        out = out.withColumn(f"__l_{n}", F.sum(f"__v_{n}").over(local))
    for n in maxima:
        out = out.withColumn(f"__l_{n}", F.max(f"__v_{n}").over(local))
    out = out.join(F.broadcast(offsets), "__chunk")
    picked = [(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums] + [F.greatest(f"__l_{n}", f"__o_{n}").alias(n) for n in maxima]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *picked)
