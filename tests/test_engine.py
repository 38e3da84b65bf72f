"""Rules against hand-worked cases and a row-by-row model."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyrill.engine import Engine
from tallyrill.plans.dialect import parse
from tallyrill.streaming.egress import Delivery, Egress, Policy
from tallyrill.streaming.windows import ExactWindows, native
from tallyrill.types import EngineConfig, RuleError, Sliding, Tumbling


def make(spark, columns, rows, name="r", **config):
    e = Engine(spark, EngineConfig(**config))
    e.def_incoming(name, columns)
    schema = "seq long, " + ", ".join(f"{n} {k}" for n, k in columns)
    e.bind(name, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema), "seq")
    return e


def values(df):
    return [tuple(r) for r in df.orderBy(*df.columns[:2]).collect()]


def test_limits_and_window(spark):
    e = make(spark, [("a", "long")], [(i,) for i in range(1, 3001)])
    assert [r[1] for r in values(e.mapper("SELECT a FROM r WHERE a >= 1"))] == list(range(3000, 2990, -1))
    assert [r[1] for r in values(e.mapper("SELECT a FROM r WHERE a >= 1 LIMIT -3"))] == [953, 954, 955]
    assert e.mapper("SELECT a FROM r LIMIT 5000").count() == 2048
    assert e.mapper("SELECT a FROM r LIMIT 0").count() == 0
    assert e.mapper("SELECT a FROM r WHERE a").count() == 0


@pytest.mark.parametrize("limit", [3, -3])
def test_trace_against_model(spark, limit):
    rng = random.Random(4)
    rows = [(rng.randrange(10),) for _ in range(200)]
    e = make(spark, [("a", "long")], rows, window_rows=16, chunk_rows=7)
    got = {(r["arrival_seq"], r["row_no"]): r["a"] for r in e.mapper(f"SELECT a FROM r WHERE a > 5 LIMIT {limit}", "trace").collect()}
    want = {}
    for i in range(len(rows)):
        ring = [a for (a,) in rows[max(0, i - 15) : i + 1] if a > 5]
        ring = ring[::-1][:3] if limit > 0 else ring[:3]
        want |= {(i, k): a for k, a in enumerate(ring)}
    assert got == want
    sizes = dict(values(e.deliveries(f"SELECT a FROM r WHERE a > 5 LIMIT {limit}")))
    assert sizes == {i: sum(k[0] == i for k in want) for i in range(len(rows))}


def test_bound_aggregates(spark):
    e = make(spark, [("f", "long"), ("a", "long")], [(100, 1), (200, 2), (300, 3)])
    e.def_stream("s", [("a", "long")])
    agg = e.def_aggregate("SELECT _suml(a) AS s, _count(a) AS n, _avg(a) AS m, _maxl(a) AS hi, _minl(a) AS lo, _firstl(a) AS f, _lastl(a) AS l, _stddev(a) AS sd, _var_samp(a) AS v FROM s")
    (row,) = e.bind_aggregate("SELECT f, a FROM r", agg).collect()
    assert tuple(row) == (6, 3, 2.0, 3, 1, 3, 1, pytest.approx(math.sqrt(2 / 3)), pytest.approx(1.0))
    trace = e.bind_aggregate("SELECT f, a FROM r", agg, "trace").orderBy("arrival_seq").select("s", "n").collect()
    assert [tuple(r) for r in trace] == [(1, 1), (3, 2), (6, 3)]
    (row,) = e.bind_aggregate("SELECT a FROM r WHERE a > 9", agg).select("s", "lo", "hi", "sd").collect()
    assert tuple(row) == (0, 2**63 - 1, -(2**63), 0.0)


def test_scalars(spark):
    nan, inf = float("nan"), float("inf")
    e = make(spark, [("a", "long"), ("b", "long"), ("x", "double"), ("z", "double")], [(9, 2, -3.7, -0.0)])
    def one(text):
        return e.mapper(f"SELECT {text} AS v FROM r").collect()[0]["v"]

    for text, want in {
        "_abs(a)": 9, "_pow(a, 2)": 81.0, "_sqrt(a)": 3.0, "_sign(a)": 1, "_to_double(a)": 9.0, "_greatest(a, b)": 9, "_least(a, b)": 2, "_to_long(x)": -3,
        "_ceil(x)": -3.0, "_floor(x)": -4.0, "_round(x)": -4.0, "_trunc(x)": -3.0, "_div(a, 0)": 0, "_mod(a, 0)": 0, "_div(-9, 2)": -4, "_mod(-9, 2)": -1, "_div(x, 0.0)": -inf,
        "_div(a, z)": -inf, "_mod(x, 2)": 0, "_sign(z)": -1.0, "_sign(0.0)": 1.0, "_ln(0)": -inf, "_log10(z)": -inf, "_exp(0)": 1.0, "_round(-2.5)": -3.0, "_add(9223372036854775807, 1)": -(2**63),
        "_greatest(_ln(-1), 2)": 2.0, "_pow(1, _ln(-1))": 1.0, "_to_long(_ln(-1))": 0, "_to_long(1e300)": 2**63 - 1, "TRUE": 1,
    }.items():
        assert one(text) == want, text
    assert math.isnan(one("_ln(-1)")) and math.isnan(one("_sqrt(-1)")) and math.isnan(one("_div(0.0, 0.0)"))
    assert math.copysign(1, one("_ceil(-0.5)")) == -1
    for text in ("_ln(-1) = _ln(-1)", "_ln(-1) != 1.0", "_ln(-1) > 1.0"):
        assert e.mapper(f"SELECT a FROM r WHERE {text}").count() == 0
    assert nan != nan


def test_windows(spark):
    e = make(spark, [("ts", "long"), ("a", "long")], [(1000, 5), (1100, 7), (1300, 11), (1400, 13)])
    assert values(e.window_aggregate("SELECT _count(a) AS n, _suml(a) AS s FROM r WHERE a > 0", Tumbling(200), "ts")) == [(1000, 1200, 2, 12, 1), (1200, 1400, 1, 11, 1), (1400, 1600, 1, 13, 1)]
    e = make(spark, [("ts", "long"), ("a", "long")], [(1000, 1), (1100, 2), (1300, 3)])
    assert [r[:1] + r[2:4] for r in values(e.window_aggregate("SELECT _count(a) AS n, _suml(a) AS s FROM r", Sliding(300, 150), "ts"))] == [(750, 1, 1), (900, 2, 3), (1050, 2, 5), (1200, 1, 3)]
    e = make(spark, [("ts", "long"), ("a", "long")], [(1000, 3), (1100, 7), (1300, 1), (1400, 2)])
    assert values(e.window_aggregate("SELECT _count(a) AS n, _suml(a) AS s FROM r WHERE a > 5", Tumbling(200), "ts")) == [(1000, 1200, 1, 7, 1), (1200, 1400, 0, 0, 0), (1400, 1600, 0, 0, 0)]
    e = make(spark, [("ts", "long"), ("a", "long")], [(-50, 1), (10, 3), (450, 2)])
    assert [r[0] for r in values(e.window_aggregate("SELECT _count(a) AS n FROM r", Sliding(100, 400), "ts"))] == [0, 400]


def test_keyed_and_late(spark):
    e = make(spark, [("ts", "long"), ("uid", "long"), ("amount", "long")], [(1000, 1, 10), (1100, 2, 20), (1200, 1, 5)])
    got = sorted(tuple(r) for r in e.keyed_window_aggregate("SELECT _count(amount) AS n, _suml(amount) AS s FROM r", Tumbling(200), "ts", "uid").collect())
    assert got == [(1000, 1200, 1, 1, 10), (1000, 1200, 2, 1, 20), (1200, 1400, 1, 1, 5)]
    e = make(spark, [("ts", "long"), ("a", "long")], [(1000, 1), (1500, 2), (1100, 3), (1300, 4)], chunk_rows=2)
    got = values(e.window_aggregate("SELECT _suml(a) AS s FROM r", Tumbling(200), "ts", 100))
    assert [(r[0], r[2]) for r in got] == [(1000, 1), (1200, 4), (1400, 2)]


def test_dimensions(spark):
    e = make(spark, [("id", "long"), ("x", "double")], [(42, 42.9), (7, 7.0)])
    d = e.def_dimension()
    e.update_dimension(d, 42, 100)
    assert [r[1:] for r in values(e.mapper(f"SELECT id, _dim_has({d}, id) AS h, _dim_get({d}, id) AS v FROM r"))] == [(7, 0, 0), (42, 1, 100)]
    assert e.mapper(f"SELECT id FROM r WHERE _dim_get({d}, x) = 100").count() == 1
    e.remove_dimension(d, 42)
    assert e.mapper(f"SELECT id FROM r WHERE _dim_has({d}, id) > 0").count() == 0
    assert e.mapper("SELECT _dim_has(9, id) AS h FROM r").collect()[0]["h"] == 0
    assert not e.update_dimension(9, 1, 1)
    b = e.def_dimension(spark.createDataFrame([(7, 70), (42, 420)], "key long, value long"))
    e.update_dimension(b, 7, 71)
    assert sorted(r["v"] for r in e.mapper(f"SELECT _dim_get({b}, id) AS v FROM r").collect()) == [71, 420]


@pytest.mark.parametrize("text", ["SELECT * FROM r", "SELECT a FROM r, s", "SELECT a FROM r GROUP BY a", "SELECT a FROM r ORDER BY a", "SELECT a + 1 FROM r", "SELECT 'x' FROM r", "SELECT A FROM r", "SELECT a FROM R",
                                  "SELECT _abs(a, a) FROM r", "SELECT _nope(a) FROM r", "SELECT a FROM r WHERE nope > 1", "SELECT a FROM r WHERE NOT a = 1", "SELECT _suml(a) FROM r", "SELECT s.a FROM r", "SELECT a FROM r LIMIT 1 OFFSET 2",
                                  "SELECT a FROM r WHERE a IN (1)", "SELECT a FROM r LIMIT x", "SELECT a, a FROM r", "DELETE FROM r"])
def test_rejected(spark, text):
    with pytest.raises(RuleError):
        make(spark, [("a", "long")], [(1,)]).mapper(text)


def test_definitions(spark):
    e = make(spark, [("a", "long"), ("x", "double")], [(1, 1.0)])
    for call in (lambda: e.def_incoming("r", []), lambda: e.window_aggregate("SELECT _count(a) AS n FROM r", None, "a"), lambda: e.window_aggregate("SELECT _count(a) AS n FROM r", Tumbling(5), "nope"),
                 lambda: e.def_aggregate("SELECT _suml(_abs(a)) AS s FROM r"), lambda: e.window_aggregate("SELECT _suml(x) AS s FROM r", Tumbling(5), "a"), lambda: e.bind_aggregate("SELECT a FROM r", 9)):
        with pytest.raises(RuleError):
            call()
    assert parse("select a as b from r limit -10").limit == -10


def test_streams(spark, tmp_path):
    rows = [(0, 1000, 1), (1, 1500, 2), (2, 1100, 3), (3, 1300, 4)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "seq long, ts long, a long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        time.sleep(0.05)
    source = spark.readStream.schema("seq long, ts long, a long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    sink = ExactWindows(str(tmp_path / "out"), Tumbling(200), "ts", 100, "seq", F.lit(True), {"s": F.sum("a")})
    source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["window_start_ms"], r["s"]) for r in sink.result(spark).collect())
    assert got == [(1000, 1), (1200, 4), (1400, 2)]
    q = native(source, Tumbling(200), "ts", 100, F.lit(True), {"s": F.sum("a")}, None).writeStream.format("memory").queryName("native_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("native_out").where("window_start_ms = 1400").count() >= 1


def test_delivery():
    seen = []
    e = Egress()
    e.deliver(seen.append, 1)
    assert seen == [1]
    e = Egress(Delivery.ASYNC)
    for i in range(2000):
        e.deliver(seen.append, i)
    assert e.flush() and len(seen) == 2001
    e.stop()
    alerts = []
    e = Egress(Delivery.ASYNC, Policy.DRAIN, 30)
    e.set_alert_listener(alerts.append)
    for _ in range(20):
        e.deliver(time.sleep, 0.15)
    assert e.flush() and e.alerts >= 1 and e.dropped >= 1 and alerts[0].policy == 1
    e.stop()
    e = Egress(Delivery.ASYNC, Policy.FAILOVER, 30)
    e.deliver(time.sleep, 0.3)
    e.deliver(seen.append, "after")
    time.sleep(0.2)
    assert e.generation >= 2 and seen[-1] == "after"
    e.stop()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_mean_nothing(spark):
    """Columns of any name keep their values; output names that are the engine's are refused."""
    e = make(spark, [("row_no", "long"), ("arrival_seq", "long"), ("window_start_ms", "long"), ("key", "long"), ("__seq", "long"), ("Key", "long")], [(100, 1, 5, 2, 7, 3), (200, 2, 7, 3, 8, 4)])
    assert values(e.mapper("SELECT row_no AS v, arrival_seq AS w, Key AS k FROM r WHERE row_no > 50")) == [(0, 200, 2, 4), (1, 100, 1, 3)]
    assert sorted(tuple(r) for r in e.mapper("SELECT row_no AS v, __seq AS s FROM r LIMIT 1", "trace").collect()) == [(0, 0, 100, 7), (1, 0, 200, 8)]
    (row,) = e.window_aggregate("SELECT _suml(window_start_ms) AS s, _maxl(row_no) AS m FROM r", Tumbling(1000), "arrival_seq").collect()
    assert tuple(row) == (0, 1000, 12, 200, 1)
    got = e.keyed_window_aggregate("SELECT _count(row_no) AS n FROM r", Tumbling(1000), "arrival_seq", "key").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1000, 2, 1), (0, 1000, 3, 1)]
    for call in (lambda: e.mapper("SELECT row_no FROM r"), lambda: e.mapper("SELECT arrival_seq FROM r", "trace"), lambda: e.window_aggregate("SELECT _count(key) AS size FROM r", Tumbling(5), "key")):
        with pytest.raises(RuleError):
            call()


@pytest.mark.parametrize("step", [1, 1_000_003, 2**40])
def test_sparse_orders(spark, step):
    """Order numbers far apart, negative and beyond the precision of doubles give the same results."""
    rng = random.Random(5)
    rows = [(i * step - 7 * step, rng.randrange(10)) for i in range(150)]
    e = Engine(spark, EngineConfig(window_rows=16, chunk_rows=7))
    e.def_incoming("r", [("a", "long")])
    e.bind("r", spark.createDataFrame(rows, "seq long, a long"), "seq")
    want = {s: sum(a > 5 for _, a in rows[max(0, i - 15) : i + 1]) for i, (s, _) in enumerate(rows)}
    sizes = e.deliveries_of({"all": "SELECT a FROM r WHERE a > 5 LIMIT 99", "two": "SELECT a FROM r WHERE a > 5 LIMIT -2"}).collect()
    assert {r["arrival_seq"]: r["all"] for r in sizes} == want
    assert {r["arrival_seq"]: r["two"] for r in sizes} == {s: min(2, n) for s, n in want.items()}
    newest = e.mapper("SELECT a FROM r WHERE a > 5 LIMIT 2", "trace").groupBy("arrival_seq").count().collect()
    assert {r["arrival_seq"]: r["count"] for r in newest} == {s: min(2, n) for s, n in want.items() if n}


def test_snapshot_reads_from_a_cutoff(spark, tmp_path):
    """The 2048th newest order number is found from that column alone and pushed to the scan of the rest."""
    spark.range(10_000).selectExpr("id AS seq", "id * 2 AS a", "id * 3 AS b").write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.def_incoming("r", [("a", "long"), ("b", "long")])
    e.bind("r", spark.read.parquet(str(tmp_path / "t")), "seq")
    df = e.mapper("SELECT a, b FROM r LIMIT 1")
    assert tuple(df.collect()[0]) == (0, 19_998, 29_997)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<seq:bigint>" in plan


def test_empty_record(spark):
    e = make(spark, [("a", "long")], [])
    assert e.mapper("SELECT a FROM r").count() == e.mapper("SELECT a FROM r", "trace").count() == e.deliveries("SELECT a FROM r").count() == 0
    assert e.window_aggregate("SELECT _count(a) AS n FROM r", Tumbling(5), "a").count() == 0


def test_entry_needs_no_session():
    """The driver's file can be imported before there is a session."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 70"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
