"""Bindings of Parquet tables to records.

Only the columns a record declares are read; times become milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def millis(c: str) -> Column:
    """Epoch milliseconds of a timestamp with or without a zone, as UTC."""
    return F.unix_millis(F.col(c).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"), millis("ts").alias("ts"), "user_id", F.round(F.col("value") * 100).cast("long").alias("amount"), "value",
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("risk"), (F.col("event_id") + (F.col("event_id") * 37) % 50).alias("late_seq"),
    )


EVENTS = [("ts", "long"), ("user_id", "long"), ("amount", "long"), ("value", "double"), ("risk", "long")]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("seq"), "o_orderkey", "o_custkey", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


ORDERS = [("o_orderkey", "long"), ("o_custkey", "long"), ("o_totalprice", "double"), ("cents", "long")]
