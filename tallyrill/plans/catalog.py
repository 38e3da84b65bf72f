"""All registered queries of the rule engine, with the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources import tables
from ..types import Sliding, Tumbling

Query = Callable[[SparkSession, str], DataFrame]

HOUR = 3_600_000


def engine(spark: SparkSession, sf_dir: str, order: str = "seq") -> Engine:
    e = Engine(spark)
    e.def_incoming("txn", tables.EVENTS)
    e.bind("txn", tables.events(spark, sf_dir), order)
    e.def_incoming("sale", tables.ORDERS)
    e.bind("sale", tables.orders(spark, sf_dir), "seq")
    return e


#: The records in SQL.
TXN = """txn AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, user_id, CAST(round(value * 100) AS BIGINT) AS amount, value,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS risk, event_id + (event_id * 37) % 50 AS late_seq FROM events)"""
SALE = "sale AS (SELECT o_orderkey AS seq, o_orderkey, o_custkey, o_totalprice, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"


def rule(sql: str) -> Query:
    return lambda spark, d: engine(spark, d).mapper(sql)


def rule_sql(select: str, where: str, limit: int = 10, record: str = "txn") -> str:
    way = "DESC" if limit >= 0 else "ASC"
    return f"""WITH {TXN}, {SALE}, latest AS (SELECT * FROM {record} ORDER BY seq DESC LIMIT 2048),
picked AS (SELECT *, row_number() OVER (ORDER BY seq {way}) - 1 AS row_no FROM latest WHERE {where})
SELECT row_no, {select} FROM picked WHERE row_no < {abs(limit)}"""


def _rules() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}

    def add(name: str, items: str, where: str | None, limit: int | None = None, sql_items: str | None = None, sql_where: str | None = None, record: str = "txn"):
        text = f"SELECT {items} FROM {record}" + (f" WHERE {where}" if where else "") + (f" LIMIT {limit}" if limit is not None else "")
        out[name] = (rule(text), rule_sql(sql_items or items, sql_where or where or "true", 10 if limit is None else limit, record))

    for name, op in (("eq", "="), ("neq", "!="), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
        add(f"filter_{name}", "user_id, amount, value", f"user_id {op} 25", 50)
    add("filter_and_or", "user_id, amount, risk", "(risk = 1 AND amount > 1000) OR (risk = 0 AND user_id <= 7)", 100)
    add("filter_mixed_type", "ts, value", "value > 20 AND amount < 5000.5", 100)
    add("filter_unary_minus", "ts, value", "-value < -50.5 AND -amount < -100", 100)
    add("filter_func_nested", "user_id, amount", "_greatest(_abs(_sub(amount, 2000)), user_id) > 1500 AND _mod(user_id, 3) = 1", 100, sql_where="greatest(abs(amount - 2000), user_id) > 1500 AND user_id % 3 = 1")
    add("filter_not_boolean", "user_id", "user_id", 10, sql_where="false")
    add("no_where", "user_id, value", None, 20)
    add("limit_newest", "ts, amount", "amount > 100", 25)
    add("limit_oldest", "ts, amount", "amount > 100", -25)
    add("limit_default10", "ts, amount", "risk = 1")
    add("limit_zero", "ts, amount", "risk = 1", 0)
    add("ring_wrap_limit", "user_id, amount", "amount >= 0", 3000)
    add("ring_wrap_oldest", "o_orderkey, o_totalprice", "o_totalprice >= 1000", -3000, record="sale")
    add("select_constants", "user_id, 7 AS seven, 2.5 AS half, TRUE AS yes", "risk = 1", 10, sql_items="user_id, CAST(7 AS BIGINT) AS seven, CAST(2.5 AS DOUBLE) AS half, CAST(1 AS BIGINT) AS yes")

    def fn(name: str, rule_expr: str, sql_expr: str):
        add(f"fn_{name}", f"amount, {rule_expr} AS r", None, 2048, sql_items=f"amount, {sql_expr} AS r")

    fn("add", "_add(amount, _add(value, 1))", "round(amount + (value + 1), 6)")
    fn("sub", "_sub(amount, user_id)", "amount - user_id")
    fn("mul", "_mul(amount, user_id)", "amount * user_id")
    fn("div", "_div(amount, _sub(user_id, 10))", "CASE WHEN user_id = 10 THEN 0 ELSE CAST(trunc(CAST(amount AS DOUBLE) / (user_id - 10)) AS BIGINT) END")
    fn("div_double", "_div(_sub(value, 10.0), risk)", "CASE WHEN risk = 0 THEN CASE WHEN value = 10 THEN CAST('nan' AS DOUBLE) WHEN value > 10 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END ELSE value - 10.0 END")
    fn("mod", "_mod(_sub(amount, 2000), _sub(user_id, 10))", "CASE WHEN user_id = 10 THEN 0 ELSE (amount - 2000) % (user_id - 10) END")
    fn("mod_double", "_mod(value, 3)", "CAST(0 AS BIGINT)")
    fn("abs", "_abs(_sub(amount, 2000))", "abs(amount - 2000)")
    fn("ceil", "_ceil(_sub(value, 20))", "CAST(ceil(value - 20) AS DOUBLE)")
    fn("floor", "_floor(_sub(value, 20))", "CAST(floor(value - 20) AS DOUBLE)")
    fn("round", "_round(_sub(value, 20))", "CAST(round(value - 20) AS DOUBLE)")
    fn("trunc", "_trunc(_sub(value, 20))", "CAST(trunc(value - 20) AS DOUBLE)")
    fn("sign", "_sign(_sub(amount, 2000))", "CAST(sign(amount - 2000) AS BIGINT)")
    fn("sign_double", "_sign(_sub(value, 20))", "CASE WHEN value - 20 < 0 THEN -1.0 ELSE 1.0 END::DOUBLE")
    fn("sqrt", "_trunc(_mul(_sqrt(amount), 1000))", "CAST(trunc(sqrt(CAST(amount AS DOUBLE)) * 1000) AS DOUBLE)")
    fn("exp", "_trunc(_mul(_exp(_div(value, 100.0)), 1000))", "CAST(trunc(exp(value / 100.0) * 1000) AS DOUBLE)")
    fn("ln", "_trunc(_mul(_ln(_mul(amount, risk)), 1000))", "CASE WHEN risk = 0 OR amount = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST(trunc(ln(CAST(amount AS DOUBLE)) * 1000) AS DOUBLE) END")
    fn("log10", "_trunc(_mul(_log10(amount), 1000))", "CASE WHEN amount = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST(trunc(log10(CAST(amount AS DOUBLE)) * 1000) AS DOUBLE) END")
    fn("to_long", "_to_long(_sub(value, 20))", "CAST(trunc(value - 20) AS BIGINT)")
    fn("to_double", "_to_double(amount)", "CAST(amount AS DOUBLE)")
    fn("pow", "_pow(user_id, 2)", "CAST(user_id AS DOUBLE) * user_id")
    fn("greatest", "_greatest(amount, 1500)", "greatest(amount, 1500)")
    fn("least", "_least(value, user_id)", "least(value, CAST(user_id AS DOUBLE))")
    out["fn_add"] = (rule("SELECT amount, _div(_round(_mul(_add(amount, _add(value, 1)), 1000)), 1000.0) AS r FROM txn LIMIT 2048"), rule_sql("amount, round((amount + (value + 1)) * 1000) / 1000.0 AS r", "true", 2048))
    return out


def _dims() -> dict[str, tuple[Query, str | None]]:
    def has_where(spark, d):
        e = engine(spark, d)
        base = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"))
        k = e.def_dimension(base)
        return e.mapper(f"SELECT user_id, amount FROM txn WHERE _dim_has({k}, user_id) > 0 LIMIT 500")

    def get_select(spark, d):
        e = engine(spark, d)
        k = e.def_dimension(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("value")))
        return e.mapper(f"SELECT user_id, _dim_has({k}, user_id) AS known, _dim_get({k}, user_id) AS nation FROM txn LIMIT 2048")

    def changed(spark, d):
        e = engine(spark, d)
        k = e.def_dimension()
        for key in range(40):
            e.update_dimension(k, key, key * 10)
        for key in range(0, 40, 3):
            e.remove_dimension(k, key)
        e.update_dimension(k, 6, 1)
        return e.mapper(f"SELECT user_id, _dim_get({k}, user_id) AS v FROM txn WHERE _dim_has({k}, user_id) = 1 LIMIT 2048")

    def over_base(spark, d):
        e = engine(spark, d)
        k = e.def_dimension(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value")))
        e.remove_dimension(k, 5)
        e.update_dimension(k, 7, 777)
        return e.mapper(f"SELECT o_custkey, _dim_get({k}, o_custkey) AS nation FROM sale WHERE _dim_get({k}, o_custkey) > 12 LIMIT 1000")

    return {
        "dim_has_where": (has_where, rule_sql("user_id, amount", "user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", 500)),
        "dim_get_select": (get_select, rule_sql("user_id, CAST(CASE WHEN user_id IN (SELECT s_suppkey FROM supplier) THEN 1 ELSE 0 END AS BIGINT) AS known, CAST(coalesce((SELECT max(s_nationkey) FROM supplier WHERE s_suppkey = user_id), 0) AS BIGINT) AS nation", "true", 2048)),
        "dim_update_remove": (changed, rule_sql("user_id, CAST(CASE WHEN user_id = 6 THEN 1 ELSE user_id * 10 END AS BIGINT) AS v", "user_id BETWEEN 0 AND 39 AND (user_id % 3 <> 0 OR user_id = 6)", 2048)),
        "dim_over_table": (
            over_base,
            f"""WITH {SALE}, latest AS (SELECT * FROM sale ORDER BY seq DESC LIMIT 2048),
dim AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS v FROM customer WHERE c_custkey NOT IN (5, 7) UNION ALL SELECT 7, 777),
picked AS (SELECT o_custkey, v AS nation, row_number() OVER (ORDER BY seq DESC) - 1 AS row_no FROM latest JOIN dim ON k = o_custkey WHERE v > 12)
SELECT row_no, o_custkey, nation FROM picked WHERE row_no < 1000""",
        ),
    }


#: Aggregate, its column, and its value over rows of ``picked`` (newest is row 0) in SQL.
AGG_SQL = {
    "suml": ("amount", "CAST(coalesce(sum(amount), 0) AS BIGINT)"), "sumd": ("amount", "CAST(coalesce(sum(amount), 0) AS DOUBLE)"), "count": ("value", "count(*)"),
    "avg": ("amount", "coalesce(avg(amount), 0.0)"), "minl": ("amount", "coalesce(min(amount), 9223372036854775807)"), "maxl": ("amount", "coalesce(max(amount), -9223372036854775807 - 1)"),
    "mind": ("value", "coalesce(min(value), 1.7976931348623157e308)"), "maxd": ("value", "coalesce(max(value), -1.7976931348623157e308)"),
    "firstl": ("amount", "coalesce(arg_min(amount, row_no), 0)"), "firstd": ("value", "coalesce(arg_min(value, row_no), 0.0)"), "lastl": ("amount", "coalesce(arg_max(amount, row_no), 0)"), "lastd": ("value", "coalesce(arg_max(value, row_no), 0.0)"),
    "stddev": ("amount", "coalesce(stddev_pop(amount), 0.0)"), "stddev_samp": ("amount", "coalesce(stddev_samp(amount), 0.0)"), "variance": ("amount", "coalesce(var_pop(amount), 0.0)"), "var_samp": ("amount", "coalesce(var_samp(amount), 0.0)"),
}
ROUNDED = {"avg", "stddev", "stddev_samp", "variance", "var_samp"}


def bound(items: str, mapper: str, mode: str = "snapshot", rounded: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d)
        e.def_stream("picked", [("amount", "long"), ("value", "double"), ("user_id", "long")])
        out = e.bind_aggregate(mapper, e.def_aggregate(f"SELECT {items} FROM picked"), mode)
        return out.withColumns({c: F.round(c, 3) for c in rounded})

    return run


def _aggregates() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for name, (column, sql) in AGG_SQL.items():
        shown = f"round({sql}, 3)" if name in ROUNDED else sql
        base = rule_sql("amount, value", "amount > 500", 1500)
        out[f"agg_{name}"] = (bound(f"_{name}({column}) AS r", "SELECT amount, value FROM txn WHERE amount > 500 LIMIT 1500", rounded=("r",) if name in ROUNDED else ()), f"SELECT {shown} AS r FROM ({base}) AS b")
    items = ", ".join(f"_{n}({c}) AS a_{n}" for n, (c, _) in AGG_SQL.items())
    empty = rule_sql("amount, value", "amount < 0", 10)
    out["agg_empty_identity"] = (bound(items, "SELECT amount, value FROM txn WHERE amount < 0"), f"SELECT {', '.join(f'{s} AS a_{n}' for n, (_, s) in AGG_SQL.items())} FROM ({empty}) AS b")
    ten = rule_sql("amount, value", "amount > 500", 10)
    out["agg_const"] = (bound("_count(amount) AS n, 1 AS one, 2.5 AS half", "SELECT amount, value FROM txn WHERE amount > 500"), f"SELECT count(*) AS n, CAST(1 AS BIGINT) AS one, CAST(2.5 AS DOUBLE) AS half FROM ({ten}) AS b")
    old = rule_sql("amount, value", "amount > 500", -100)
    out["bind_agg_snapshot"] = (bound("_suml(amount) AS s, _firstl(amount) AS f, _lastl(amount) AS l, _count(value) AS n", "SELECT value, amount FROM txn WHERE amount > 500 LIMIT -100"), f"SELECT CAST(sum(amount) AS BIGINT) AS s, arg_min(amount, row_no) AS f, arg_max(amount, row_no) AS l, count(*) AS n FROM ({old}) AS b")
    out["bind_agg_trace"] = (
        bound("_suml(amount) AS s, _maxl(amount) AS m, _firstl(amount) AS f, _count(amount) AS n", "SELECT amount FROM txn WHERE risk = 1 AND amount > 500 LIMIT 10", "trace"),
        f"SELECT arrival_seq, CAST(sum(amount) AS BIGINT) AS s, max(amount) AS m, arg_min(amount, row_no) AS f, count(*) AS n FROM ({trace_sql('amount', 'risk = 1 AND amount > 500', 10)}) AS b GROUP BY arrival_seq",
    )
    return out


def trace_sql(select: str, where: str, limit: int, record: str = "txn") -> str:
    n = abs(limit)
    lo, hi, no = ("greatest(mm - {n}, ff) + 1", "mm", "mm - k") if limit >= 0 else ("ff + 1", "least(ff + {n}, mm)", "k - ff - 1")
    return f"""WITH {TXN}, {SALE}, r AS (SELECT *, CASE WHEN {where} THEN 1 ELSE 0 END AS m FROM {record}),
o AS (SELECT *, CAST(sum(m) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mm,
  CAST(coalesce(sum(m) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 2048 PRECEDING), 0) AS BIGINT) AS ff FROM r),
e AS (SELECT seq AS arrival_seq, mm, ff, unnest(range({lo.format(n=n)}, {hi.format(n=n)} + 1)) AS k FROM o),
x AS (SELECT mm AS k, * EXCLUDE (mm, ff, m) FROM o WHERE m = 1)
SELECT arrival_seq, {no} AS row_no, {select} FROM e JOIN x USING (k)"""


def _traces() -> dict[str, tuple[Query, str | None]]:
    def trace(sql: str) -> Query:
        return lambda spark, d: engine(spark, d).mapper(sql, "trace")

    def sizes(spark, d):
        e = engine(spark, d)
        return e.deliveries_of({"first_size": "SELECT amount FROM txn WHERE amount > 0 LIMIT 10", "second_size": "SELECT amount FROM txn WHERE amount > 5000 LIMIT 10"})

    count = "CAST(least(10, coalesce(sum(CASE WHEN amount > {x} THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN 2047 PRECEDING AND CURRENT ROW), 0)) AS BIGINT)"
    return {
        "mapper_trace_newest": (trace("SELECT user_id, amount FROM txn WHERE risk = 1 LIMIT 10"), trace_sql("user_id, amount", "risk = 1", 10)),
        "mapper_trace_oldest": (trace("SELECT user_id, amount FROM txn WHERE risk = 1 LIMIT -10"), trace_sql("user_id, amount", "risk = 1", -10)),
        "multi_mapper": (sizes, f"WITH {TXN} SELECT seq AS arrival_seq, {count.format(x=0)} AS first_size, {count.format(x=5000)} AS second_size FROM txn"),
    }


def window_sql(fields: str, where: str, length: int, slide: int, lag: int, order: str, key: str | None) -> str:
    """Starts k * slide with start <= ts < start + length; rows of windows that
    end before the watermark at their arrival are out."""
    many = max(1, -(-length // slide))
    group = f"GROUP BY ws{', key' if key else ''}"
    body = f"SELECT ws AS window_start_ms, ws + {length} AS window_end_ms, {'key, ' if key else ''}{fields}{'' if key else ', CAST(least(count(*) FILTER (WHERE p), 1) AS BIGINT) AS size'} FROM d {'WHERE p ' if key else ''}{group}"
    return f"""WITH {TXN}, a AS (SELECT *, {key or 0} AS key, {order} AS ord, max(ts) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) - {lag} AS wm, ({where}) AS p FROM txn),
c AS (SELECT *, ts - ((ts % {slide}) + {slide}) % {slide} - i * {slide} AS ws FROM a, range({many}) AS g(i)),
d AS (SELECT * FROM c WHERE ws + {length} > ts AND ws + {length} >= wm)
{body}"""


def _windows() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}

    def add(name: str, fields: str, sql: str, where: str | None, window, lag: int = 0, key: str | None = None, order: str = "seq"):
        text = f"SELECT {fields} FROM txn" + (f" WHERE {where}" if where else "")
        length, slide = (window.period_ms, window.period_ms) if isinstance(window, Tumbling) else (window.length_ms, window.slide_ms)

        def run(spark, d):
            e = engine(spark, d, order)
            return e.keyed_window_aggregate(text, window, "ts", key, lag) if key else e.window_aggregate(text, window, "ts", lag)

        out[name] = (run, window_sql(sql, where or "true", length, slide, lag, order, key))

    total = "_count(amount) AS n, _suml(amount) AS s"
    plain = "count(*) FILTER (WHERE p) AS n, CAST(coalesce(sum(amount) FILTER (WHERE p), 0) AS BIGINT) AS s"
    add("win_tumbling", total, plain, None, Tumbling(HOUR))
    add("win_sliding", total, plain, "amount > 0", Sliding(3 * HOUR, HOUR))
    add("win_sliding_gap", total, plain, None, Sliding(HOUR, 3 * HOUR))
    add("win_filter_empty", total + ", _maxl(amount) AS m", plain + ", coalesce(max(amount) FILTER (WHERE p), -9223372036854775807 - 1) AS m", "amount > 12000", Tumbling(HOUR // 4))
    add("win_keyed", total + ", _minl(amount) AS lo, _maxl(amount) AS hi", plain + ", min(amount) AS lo, max(amount) AS hi", "amount > 0", Tumbling(6 * HOUR), key="user_id")
    add("win_keyed_sliding", total + ", _firstl(amount) AS f, _lastl(amount) AS l", plain + ", arg_min(amount, ord) AS f, arg_max(amount, ord) AS l", None, Sliding(6 * HOUR, 2 * HOUR), key="user_id")
    add("win_late_drop", total, plain, None, Tumbling(HOUR // 4), 60_000, order="late_seq * 100000000 + seq")
    add("win_keyed_late_drop", total, plain, None, Sliding(HOUR, HOUR // 2), 60_000, "user_id", order="late_seq * 100000000 + seq")

    def late(name: str, text: str, window, key):
        def run(spark, d):
            e = engine(spark, d)
            src = tables.events(spark, d)
            # arrival order: a unique number that keeps chunks of arrivals together
            src = src.withColumn("arrival", F.col("late_seq") * 64 + F.pmod(F.col("seq"), F.lit(64)))
            e.bind("txn", src, "arrival")
            return e.keyed_window_aggregate(text, window, "ts", key, 60_000) if key else e.window_aggregate(text, window, "ts", 60_000)

        out[name] = (run, out[name][1].replace("late_seq * 100000000 + seq", "late_seq * 64 + seq % 64"))

    late("win_late_drop", f"SELECT {total} FROM txn", Tumbling(HOUR // 4), None)
    late("win_keyed_late_drop", f"SELECT {total} FROM txn", Sliding(HOUR, HOUR // 2), "user_id")

    def several(spark, d):
        e = engine(spark, d)
        a = e.window_aggregate("SELECT _suml(amount) AS s FROM txn", Tumbling(HOUR), "ts").drop("size")
        b = e.window_aggregate("SELECT _maxl(user_id) AS m FROM txn WHERE risk = 1", Tumbling(HOUR), "ts").drop("size", "window_end_ms")
        return a.join(b, "window_start_ms")

    out["win_multi_agg"] = (several, f"WITH {TXN} SELECT ts - ts % {HOUR} AS window_start_ms, ts - ts % {HOUR} + {HOUR} AS window_end_ms, CAST(sum(amount) AS BIGINT) AS s, coalesce(max(user_id) FILTER (WHERE risk = 1), -9223372036854775807 - 1) AS m FROM txn GROUP BY 1, 2")

    def processing(spark, d):
        e = engine(spark, d)
        return e.window_aggregate("SELECT _count(ts) AS n FROM txn", Tumbling(HOUR), None, arrival_ms="ts")

    out["win_processing_time"] = (processing, f"WITH {TXN} SELECT ts - ts % {HOUR} AS window_start_ms, ts - ts % {HOUR} + {HOUR} AS window_end_ms, count(*) AS n, CAST(1 AS BIGINT) AS size FROM txn GROUP BY 1, 2")
    return out


def _all() -> dict[str, tuple[Query, str | None]]:
    return _rules() | _dims() | _aggregates() | _traces() | _windows()


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
