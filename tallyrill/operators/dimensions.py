"""Keyed lookup tables: whole number to whole number, last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Dimension:
    """A table ``key, value`` and what has been written over it since."""

    def __init__(self, spark: SparkSession, base: DataFrame | None = None):
        self.spark, self.base = spark, base
        self.written: dict[int, int | None] = {}

    def update(self, key: int, value: int) -> None:
        self.written[int(key)] = int(value)

    def remove(self, key: int) -> None:
        self.written[int(key)] = None

    def frame(self) -> DataFrame:
        """The table as it stands, a row a key."""
        over = self.spark.createDataFrame([(k, v) for k, v in self.written.items()], "key long, value long")
        now = over.where("value IS NOT NULL")
        if self.base is None:
            return now
        base = self.base.select(F.col("key").cast("long"), F.col("value").cast("long")).groupBy("key").agg(F.max("value").alias("value"))
        return (base.join(over.select("key"), "key", "left_anti") if self.written else base).unionByName(now)

    def literal(self, most: int) -> dict[int, int] | None:
        """All entries, if they were all written one by one and are few."""
        now = {k: v for k, v in self.written.items() if v is not None}
        return now if self.base is None and len(now) <= most else None


def lookup_literal(entries: dict[int, int], key: Column) -> tuple[Column, Column]:
    """``has`` (1 or 0) and ``value`` (0 where absent) without a join."""
    if not entries:
        return F.lit(0).cast("long"), F.lit(0).cast("long")
    table = F.create_map(*[F.lit(x).cast("long") for pair in entries.items() for x in pair])
    value = F.try_element_at(table, key)
    return value.isNotNull().cast("long"), F.coalesce(value, F.lit(0).cast("long"))


def lookup_join(df: DataFrame, dim: DataFrame, key: Column, name: str) -> tuple[DataFrame, Column, Column]:
    """The same by a left join, which Spark broadcasts if the table's size allows it."""
    d = dim.select(F.col("key").alias(f"{name}_k"), F.col("value").alias(f"{name}_v"))
    out = df.withColumn(f"{name}_key", key).join(d, F.col(f"{name}_key") == F.col(f"{name}_k"), "left")
    return out, F.col(f"{name}_k").isNotNull().cast("long"), F.coalesce(F.col(f"{name}_v"), F.lit(0).cast("long"))
