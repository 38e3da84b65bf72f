"""Seconds for each headline query at ``BENCH_SF_DIR``, and what a row costs: the
same queries over ``MORE`` times as many events tell the cost of a row from that
of a job. One JSON line."""

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyrill.plans import catalog

HEADLINE = (
    "filter_and_or", "filter_func_nested", "ring_wrap_limit", "dim_has_where", "agg_stddev", "bind_agg_snapshot", "bind_agg_trace", "mapper_trace_newest", "multi_mapper",
    "win_tumbling", "win_sliding", "win_keyed", "win_keyed_sliding", "win_late_drop", "win_keyed_late_drop",
)
MORE = int(os.environ.get("BENCH_MORE", "40"))


def timed(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    found, times = catalog.queries(), {}
    for name in HEADLINE:
        for _ in range(2):  # the second run is warm and counts
            began = time.time()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    return times


def enlarged(spark: SparkSession, sf_dir: str, to: str) -> int:
    """The tables with ``MORE`` copies of the events, one after the other in
    order and time; the number of events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, first, last = events.agg(F.max("event_id") + 1, F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    copies = events.crossJoin(F.broadcast(spark.range(MORE).withColumnRenamed("id", "copy")))
    ts = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("copy") * (last - first + 1))
    moved = copies.withColumn("ts", ts).withColumn("event_id", F.col("event_id") + F.col("copy") * n).drop("copy")
    moved.repartitionByRange(16, "event_id").sortWithinPartitions("event_id").write.parquet(f"{to}/events.parquet")
    for t in ("customer", "supplier", "orders"):
        os.symlink(f"{sf_dir}/{t}.parquet", f"{to}/{t}.parquet")
    return events.count()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = timed(spark, sf_dir)
    out = {"metric": "headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
    if MORE > 1:
        to = tempfile.mkdtemp(prefix="tallyrill-bench-")
        try:
            n = enlarged(spark, sf_dir, to)
            more = timed(spark, to)
        finally:
            shutil.rmtree(to)
        out["events"] = [n, n * MORE]
        out["queries_more"] = more
        out["rows_per_sec_more"] = {k: round(n * MORE / x) for k, x in more.items()}
        out["us_per_further_row"] = {k: round((more[k] - times[k]) / (n * (MORE - 1)) * 1e6, 4) for k in more}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
