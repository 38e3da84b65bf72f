"""Rules with callbacks over streams, against the same rules over all arrivals at once."""

import random
import threading
import time

import pytest

from tallyrill.engine import Engine
from tallyrill.streaming.egress import Delivery, Policy
from tallyrill.types import EngineConfig, RuleError, Sliding, Tumbling

COLUMNS = [("ts", "long"), ("uid", "long"), ("a", "long")]
SCHEMA = "seq long, ts long, uid long, a long"


def arrivals(n=90, seed=3):
    r = random.Random(seed)
    return [(i, 1000 + 40 * i + r.choice([0, 0, -300, 150]), r.randrange(3), r.randrange(10)) for i in range(n)]


def feed(spark, tmp_path, rows, cuts):
    for k, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[x:y], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))
        time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def engine(spark):
    e = Engine(spark, EngineConfig(window_rows=16, chunk_rows=7))
    e.def_incoming("r", COLUMNS)
    e.def_stream("s", [("a", "long")])
    return e


def test_rows_and_aggregates(spark, tmp_path):
    rows = arrivals()
    e, got = engine(spark), {k: [] for k in ("new", "old", "agg")}
    e.on_rows("SELECT a, seq FROM r WHERE a > 5 LIMIT 3".replace(", seq", ""), got["new"].append)
    e.on_rows("SELECT a, uid FROM r WHERE a > 5 LIMIT -2", got["old"].append)
    e.on_aggregate("SELECT a FROM r WHERE a > 5", e.def_aggregate("SELECT _suml(a) AS s, _count(a) AS n FROM s"), got["agg"].append)
    d = e.def_dimension()
    e.update_dimension(d, 1, 5)
    seen = []
    e.on_rows(f"SELECT uid FROM r WHERE _dim_has({d}, uid) > 0 LIMIT 1", seen.append)
    e.start("r", feed(spark, tmp_path, rows, [1, 30, 37, 80]), "seq", str(tmp_path / "out"), availableNow=True).awaitTermination()
    rings = [[x for x in rows[max(0, i - 15) : i + 1] if x[3] > 5] for i in range(len(rows))]
    assert got["new"] == [[(x[3],) for x in ring[::-1][:3]] for ring in rings]
    assert got["old"] == [[(x[3], x[2]) for x in ring[:2]] for ring in rings]
    assert got["agg"] == [[(sum(x[3] for x in ring[::-1][:10]), min(10, len(ring)))] if ring else [] for ring in rings]
    assert len(seen) == len(rows) and any(seen)
    assert len(list((tmp_path / "out" / "state" / "tail").iterdir())) == 2
    e.stop()
    with pytest.raises(RuleError):
        e.start("r", spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*")), "seq", str(tmp_path / "more"))


@pytest.mark.parametrize("window", [Tumbling(200), Sliding(300, 100)])
def test_windows(spark, tmp_path, window):
    rows = arrivals()
    e, plain, keyed = engine(spark), [], []
    text = "SELECT _count(a) AS n, _suml(a) AS s, _lastl(a) AS l FROM r WHERE a > 2"
    e.on_window(text, window, lambda r: plain.append(tuple(r)), "ts", lag_ms=100)
    e.on_window(text, window, lambda r: keyed.append(tuple(r)), "ts", "uid", 100)
    e.start("r", feed(spark, tmp_path, rows, [1, 30, 37, 80]), "seq", str(tmp_path / "out"), availableNow=True).awaitTermination()
    e.bind("r", spark.createDataFrame(rows, SCHEMA), "seq")
    wm = max(r[1] for r in rows) - 100
    want = {tuple(r) for r in e.window_aggregate(text, window, "ts", 100).collect()}
    assert sorted(plain) == sorted(r for r in want if r[1] < wm) and len(plain) > 5
    want_keyed = {tuple(r) for r in e.keyed_window_aggregate(text, window, "ts", "uid", 100).collect()}
    assert sorted(keyed) == sorted(r for r in want_keyed if r[1] < wm)
    kept = spark.read.parquet(str(next((tmp_path / "out" / "state" / "window-0").glob("4-*")) / "rows"))
    assert 0 < kept.count() < 40  # rows of open windows alone
    e._live[0][0].fire(10**12)  # the clock closes the rest, once
    e._live[0][0].fire(10**12)
    assert sorted(plain) == sorted(want) and sorted(keyed) == sorted(want_keyed)
    e.stop()


def test_idle_firing_and_clock(spark, tmp_path):
    e, got, timed = engine(spark), [], []
    e.on_window("SELECT _count(a) AS n FROM r", Tumbling(200), got.append, "ts")
    e.on_window("SELECT _count(a) AS n FROM r", Tumbling(50), timed.append)
    q = e.start("r", feed(spark, tmp_path, [(0, 1000, 1, 1), (1, 1100, 1, 1)], []), "seq", str(tmp_path / "out"), idle_ms=200)
    end = time.time() + 30
    while (not got or not timed) and time.time() < end:
        time.sleep(0.1)
    assert [r["n"] for r in got] == [2] and [r["n"] for r in timed] == [2] and q.exception() is None
    e.stop()


def test_delivery_settings(spark):
    e, done, alerts = engine(spark), threading.Event(), []
    e.set_delivery_mode(Delivery.ASYNC)
    e.set_egress_policy(Policy.DRAIN, 30)
    e.set_alert_listener(alerts.append)
    for _ in range(10):
        e.egress.deliver(time.sleep, 0.15)
    assert e.egress.flush() and e.gauges()["alerts"] >= 1 and e.gauges()["dropped"] >= 1 and alerts and e.gauges()["pending"] == 0
    e.egress.deliver(done.set)
    assert e.egress.flush() and done.is_set()
    e.stop()


def test_bad_rules_fail_at_once(spark):
    e = engine(spark)
    for call in (lambda: e.on_rows("SELECT nope FROM r", print), lambda: e.on_aggregate("SELECT a FROM r", 7, print), lambda: e.on_window("SELECT _count(a) AS n FROM r", None, print, "ts")):
        with pytest.raises(RuleError):
            call()
