"""The public API: records, rules, aggregates, time windows and dimensions."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .functions.aggregates import AGGREGATES, build, result_kind
from .operators import count_window, time_window
from .operators.dimensions import Dimension, lookup_join, lookup_literal
from .plans.binder import Binder, field_name
from .plans.dialect import Call, Name, Number, Query, Truth, parse
from .streaming.egress import Delivery, Egress, Policy
from .streaming.live import Live, LiveWindow, RowRule
from .types import DOUBLE, LONG, Column, EngineConfig, RuleError, Window, bounds

log = logging.getLogger("tallyrill")


@dataclass
class Record:
    """A declared record; ``data`` and ``order`` once arrivals are bound."""

    id: int
    name: str
    kind: str
    columns: list[Column]
    data: DataFrame | None = None
    order: str | None = None

    @property
    def places(self) -> dict[str, str]:
        """The names of the record's columns in ``data``: of a namespace of their
        own, so that no column's name means anything to the engine."""
        return {c.name: f"__f{i}" for i, c in enumerate(self.columns)}


@dataclass
class Aggregate:
    """An aggregate list over a record of kind stream."""

    id: int
    record: Record
    query: Query


@dataclass
class WindowRule:
    """A window aggregate over a record's data."""

    window: Window
    ts: str
    lag_ms: int
    fields: dict[str, SparkColumn]
    key: str | None

    def result(self, rows: DataFrame) -> DataFrame:
        return time_window.aggregated(rows, self.window, F.col("__pass"), self.fields, self.key)


#: Stands for the time at which a micro-batch is worked on; no record has such a column.
CLOCK = "the clock"
#: The engine's own output columns, by mode: name in the plan, name in the result.
PLACES = {"snapshot": [("__row", "row_no")], "trace": [("__arrival", "arrival_seq"), ("__row", "row_no")]}


@dataclass
class _Scope:
    """The rows of a rule, to which lookups may join dimensions."""

    df: DataFrame
    joins: int = 0


@dataclass
class Engine:
    """Rules over bound data. All calls but the definitions return DataFrames;
    nothing runs before these do."""

    spark: SparkSession
    config: EngineConfig = field(default_factory=EngineConfig)

    def __post_init__(self):
        # Whole numbers wrap and casts saturate, as the rules define.
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.records: dict[str, Record] = {}
        self.aggregates: list[Aggregate] = []
        self.dimensions: list[Dimension] = []
        self.egress, self.stopped = Egress(), False
        self._on_rows: dict[str, list[RowRule]] = {}
        self._on_windows: dict[str, list[LiveWindow]] = {}
        self._live: list[tuple[Live, StreamingQuery]] = []
        log.setLevel(self.config.log_level)

    # -- definitions

    def def_incoming(self, name: str, columns: list) -> int:
        return self._define(name, columns, "incoming")

    def def_stream(self, name: str, columns: list) -> int:
        return self._define(name, columns, "stream")

    def _define(self, name: str, columns: list, kind: str) -> int:
        if name in self.records:
            raise RuleError(f"record {name} exists")
        made = [c if isinstance(c, Column) else Column(*c) for c in columns]
        # of columns of one name the last counts
        self.records[name] = Record(len(self.records) + 1, name, kind, list({c.name: c for c in made}.values()))
        return self.records[name].id

    def bind(self, name: str, df: DataFrame, order: str) -> None:
        """Arrivals of a record, in the order of the unique whole-number column
        ``order``. Columns are cast; what is missing or null is 0."""
        rec = self._record(name)
        rec.data, rec.order = self._cast(rec, df, order), "__seq"

    @staticmethod
    def _cast(rec: Record, df: DataFrame, order: str) -> DataFrame:
        at = {c: f"__s{i}" for i, c in enumerate(df.columns)}  # by place: names may differ by case alone
        have = {c.lower(): n for c, n in at.items()} | at
        if order not in df.columns:
            raise RuleError(f"no order column {order}")
        cast = []
        for c in rec.columns:
            kind = "double" if c.kind == DOUBLE else "long"
            named = have.get(c.name, have.get(c.name.lower()))
            found = F.col(named).cast(kind) if named else F.lit(0).cast(kind)
            cast.append(F.coalesce(found, F.lit(0).cast(kind)).alias(rec.places[c.name]))
        return df.toDF(*at.values()).select(*cast, F.col(at[order]).cast("long").alias("__seq"))

    def def_dimension(self, base: DataFrame | None = None) -> int:
        """A lookup table, empty or over the columns ``key, value`` of ``base``."""
        self.dimensions.append(Dimension(self.spark, base))
        return len(self.dimensions) - 1

    def update_dimension(self, dim: int, key: int, value: int) -> bool:
        if not 0 <= dim < len(self.dimensions):
            log.warning("no dimension %s", dim)
            return False
        self.dimensions[dim].update(key, value)
        return True

    def remove_dimension(self, dim: int, key: int) -> bool:
        if not 0 <= dim < len(self.dimensions):
            log.warning("no dimension %s", dim)
            return False
        self.dimensions[dim].remove(key)
        return True

    def def_aggregate(self, sql: str) -> int:
        """An aggregate list over a record; a WHERE or LIMIT in it has no effect."""
        query = parse(sql)
        agg = Aggregate(len(self.aggregates) + 1, self._record(query.record), query)
        columns = {c.name for c in agg.record.columns}
        for item in query.items:
            self._aggregate_call(item.expr, columns, query.record)
        self.aggregates.append(agg)
        return agg.id

    # -- queries

    def mapper(self, sql: str, mode: str = "snapshot") -> DataFrame:
        """Rows that a rule selects: ``row_no`` and its fields; with mode trace
        also ``arrival_seq``, the arrival after which."""
        rows, named = self._ruled(sql, mode)
        self._distinct([n for n, _, _ in named], [n for _, n in PLACES[mode]])
        return rows.select(*[F.col(c).alias(n) for c, n in PLACES[mode]], *[c.alias(n) for n, c, _ in named])

    def deliveries(self, sql: str) -> DataFrame:
        """``arrival_seq, size`` of every arrival: how many rows a rule delivers,
        0 included."""
        return self.deliveries_of({"size": sql})

    def deliveries_of(self, rules: dict[str, str]) -> DataFrame:
        """``arrival_seq`` and a column of sizes for each of several rules over
        one record, by name, in one pass."""
        found = [self._rule(sql) for sql in rules.values()]
        if len({rec.name for rec, _, _ in found}) != 1:
            raise RuleError("rules over one record")
        rec, scope = found[0][0], _Scope(self._data(found[0][0]))
        wheres = [(self._binder(rec, scope).where(query.where), limit) for _, query, limit in found]
        out = count_window.sizes(scope.df, rec.order, wheres, self.config.window_rows, self.config.chunk_rows)
        return out.select(F.col("__arrival").alias("arrival_seq"), *[F.col(f"__size_{i}").alias(n) for i, n in enumerate(rules)])

    def bind_aggregate(self, sql: str, aggregate: int, mode: str = "snapshot") -> DataFrame:
        """An aggregate over what a rule delivers: one row, or one an arrival that
        delivers any. Columns are matched by name; first and last go by delivery."""
        if not 1 <= aggregate <= len(self.aggregates):
            raise RuleError(f"no aggregate {aggregate}")
        return self._aggregated(*self._ruled(sql, mode), aggregate, mode).withColumnsRenamed({"__arrival": "arrival_seq"})

    def window_aggregate(self, sql: str, window: Window, ts_field: str | None = None, lag_ms: int = 0, arrival_ms: str | None = None) -> DataFrame:
        """One row a time window: ``window_start_ms, window_end_ms``, the fields
        and ``size`` (1, or 0 if the condition let nothing pass). Without
        ``ts_field`` the time of arrival counts, column ``arrival_ms``."""
        return self._windowed(sql, window, ts_field or arrival_ms, lag_ms, None)

    def keyed_window_aggregate(self, sql: str, window: Window, ts_field: str | None, key_field: str, lag_ms: int = 0, arrival_ms: str | None = None) -> DataFrame:
        """One row a time window and value of ``key_field``."""
        if not key_field:
            raise RuleError("a keyed window aggregate needs a key")
        return self._windowed(sql, window, ts_field or arrival_ms, lag_ms, key_field)

    # -- callbacks and streams

    def on_rows(self, sql: str, callback: Callable[[list], None]) -> None:
        """After each arrival of a stream, the rows that a rule selects, as tuples
        of its fields in delivery order; none, too. Rules of a record are called
        in the order in which they were given."""
        rec, query, limit = self._rule(sql)
        self._binder(rec, _Scope(self._nothing(rec))).named(query)  # what cannot be bound fails here

        def trace(data: DataFrame) -> DataFrame:
            rows, named = self._traced(rec, data, query, limit)
            return rows.select("__arrival", "__row", *[c.alias(f"__o{i}") for i, (_, c, _) in enumerate(named)])

        self._on_rows.setdefault(rec.name, []).append(RowRule(trace, callback))

    def on_aggregate(self, sql: str, aggregate: int, callback: Callable[[list], None]) -> None:
        """After each arrival, a bound aggregate over what a rule selects, as a
        list of one tuple, or of none where it selects nothing."""
        if not 1 <= aggregate <= len(self.aggregates):
            raise RuleError(f"no aggregate {aggregate}")
        rec, query, limit = self._rule(sql)

        def trace(data: DataFrame) -> DataFrame:
            rows, named = self._traced(rec, data, query, limit)
            out = self._aggregated(rows, named, aggregate, "trace")
            return out.select("__arrival", F.lit(0).cast("long").alias("__row"), *[c for c in out.columns if c != "__arrival"])

        trace(self._nothing(rec))
        self._on_rows.setdefault(rec.name, []).append(RowRule(trace, callback))

    def on_window(self, sql: str, window: Window, callback: Callable, ts_field: str | None = None, key_field: str | None = None, lag_ms: int = 0) -> None:
        """The row of each time window, of each key if ``key_field`` is given, when
        it closes. Without ``ts_field`` the time of the micro-batch counts."""
        rec, passed, rule = self._window_rule(sql, window, ts_field or CLOCK, key_field, lag_ms)
        self._on_windows.setdefault(rec.name, []).append(LiveWindow(passed, rule, callback, lag_ms))

    def start(self, name: str, stream: DataFrame, order: str, path: str, idle_ms: int | None = None, **trigger) -> StreamingQuery:
        """Run the callbacks of a record over a streaming DataFrame, whose unique
        whole-number column ``order`` grows from batch to batch. ``path``, a
        folder that driver and executors share, holds what must outlive them."""
        if self.stopped:
            raise RuleError("the engine has stopped")
        rec = self._record(name)
        live = Live(self.spark, f"{path}/state", self.egress, self._on_rows.get(name, []), self._on_windows.get(name, []), self.config.window_rows, self.config.chunk_rows, idle_ms)
        data = self._cast(rec, stream, order)

        def batch(df: DataFrame, batch_id: int) -> None:
            live(df.withColumn("__clock", F.lit(int(time.time() * 1000)).cast("long")), batch_id)

        writer = data.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint")
        query = (writer.trigger(**trigger) if trigger else writer).start()
        self._live.append((live, query))
        return query

    def set_delivery_mode(self, mode: Delivery) -> None:
        self.egress.delivery = mode

    def set_egress_policy(self, policy: Policy, threshold_ms: int) -> None:
        self.egress.set_policy(policy, threshold_ms)

    def set_alert_listener(self, listener: Callable | None) -> None:
        self.egress.set_alert_listener(listener)

    def gauges(self) -> dict[str, int]:
        """Results that wait, were dropped, and alerts so far."""
        return {"pending": self.egress.pending, "dropped": self.egress.dropped, "alerts": self.egress.alerts}

    def stop(self) -> None:
        """End all streams and delivery, for good. Windows that are open are not
        delivered; their rows stay at the streams' paths."""
        self.stopped = True
        for live, query in self._live:
            live.stop()
            query.stop()
        self.egress.stop()

    # -- parts

    def _record(self, name: str) -> Record:
        if name not in self.records:
            raise RuleError(f"no record {name}")
        return self.records[name]

    def _data(self, rec: Record) -> DataFrame:
        if rec.data is None:
            raise RuleError(f"record {rec.name} has no data bound")
        return rec.data

    def _rule(self, sql: str) -> tuple[Record, Query, int]:
        query = parse(sql)
        return self._record(query.record), query, self.config.default_limit if query.limit is None else query.limit

    def _binder(self, rec: Record, scope: _Scope) -> Binder:
        def lookup(dim: int, key: SparkColumn) -> tuple[SparkColumn, SparkColumn]:
            if not 0 <= dim < len(self.dimensions):
                return lookup_literal({}, key)
            d = self.dimensions[dim]
            entries = d.literal(self.config.map_literal_keys)
            if entries is not None:
                return lookup_literal(entries, key)
            scope.joins += 1
            scope.df, has, value = lookup_join(scope.df, d.frame(), key, f"__d{scope.joins}")
            return has, value

        return Binder(rec.name, rec.columns, lookup, rec.places)

    def _ruled(self, sql: str, mode: str) -> tuple[DataFrame, list[tuple[str, SparkColumn, str]]]:
        """The rows that a rule selects, with its output columns (name, Column, type)."""
        rec, query, limit = self._rule(sql)
        if mode not in PLACES:
            raise RuleError(f"mode {mode}: snapshot or trace")
        rows, order, most = self._data(rec), rec.order, self.config.window_rows
        if mode == "trace":
            return self._traced(rec, rows, query, limit)
        # Lookups meet the latest rows alone, as these are all that counts.
        scope = _Scope(count_window.latest(rows, order, most))
        binder = self._binder(rec, scope)
        where, named = binder.where(query.where), binder.named(query)
        return count_window.snapshot(scope.df, order, where, limit), named

    def _traced(self, rec: Record, data: DataFrame, query: Query, limit: int) -> tuple[DataFrame, list[tuple[str, SparkColumn, str]]]:
        scope = _Scope(data)
        binder = self._binder(rec, scope)
        where, named = binder.where(query.where), binder.named(query)
        return count_window.trace(scope.df, "__seq", where, limit, self.config.window_rows, self.config.chunk_rows), named

    def _aggregated(self, rows: DataFrame, named: list[tuple[str, SparkColumn, str]], aggregate: int, mode: str) -> DataFrame:
        """The fields of a bound aggregate; with mode trace behind ``__arrival``."""
        rows = rows.select(*[c for c, _ in PLACES[mode]], *[c.alias(f"__o{i}") for i, (_, c, _) in enumerate(named)])
        kinds = {n: (f"__o{i}", k) for i, (n, _, k) in enumerate(named)}
        fields = self._fields(self.aggregates[aggregate - 1].query, kinds, F.col("__row"), None, newest_first=False)
        if mode != "trace":
            return rows.agg(*[c.alias(n) for n, c in fields.items()])
        self._distinct(list(fields), ["arrival_seq"])
        out = rows.groupBy("__arrival").agg(*[c.alias(f"__a{i}") for i, c in enumerate(fields.values())])
        return out.select("__arrival", *[F.col(f"__a{i}").alias(n) for i, n in enumerate(fields)])

    def _nothing(self, rec: Record) -> DataFrame:
        """No arrivals of a record."""
        return self.spark.createDataFrame([], ", ".join([f"{rec.places[c.name]} {c.kind}" for c in rec.columns] + ["__seq long"]))

    @staticmethod
    def _distinct(names: list[str], own: list[str]) -> None:
        """Output columns may not bear the names of the engine's own."""
        for n in names:
            if n.lower() in own:
                raise RuleError(f"two output columns named {n}; use AS")

    @staticmethod
    def _aggregate_call(e, columns: set[str], record: str) -> tuple[str, str] | None:
        """Name and column of an aggregate, None for a constant."""
        if isinstance(e, (Number, Truth)):
            return None
        if not isinstance(e, Call) or e.name not in AGGREGATES:
            raise RuleError("an aggregate list has aggregates and constants")
        if len(e.args) != 1 or not isinstance(e.args[0], Name):
            raise RuleError(f"{e.name} takes one bare column")
        name = e.args[0]
        if name.record not in (None, record) or name.name not in columns:
            raise RuleError(f"no column {name.name} in {record}")
        return e.name, name.name

    def _fields(self, query: Query, kinds: dict[str, tuple[str, str]], order: SparkColumn, when: SparkColumn | None, newest_first: bool) -> dict[str, SparkColumn]:
        out: dict[str, SparkColumn] = {}
        for k, item in enumerate(query.items):
            found = self._aggregate_call(item.expr, set(kinds), query.record)
            name = field_name(item, k)
            if name in out:
                raise RuleError(f"two output columns named {name}; use AS")
            if found is None:
                v = item.expr.value
                out[name] = F.max(F.lit(v).cast("double" if isinstance(v, float) else "long"))
            else:
                place, kind = kinds[found[1]]
                out[name] = build(found[0], F.col(f"`{place}`"), kind, order, when, newest_first)
        return out

    def _windowed(self, sql: str, window: Window, ts: str | None, lag_ms: int, key: str | None) -> DataFrame:
        rec, df, spec = self._window_rule(sql, window, ts, key, lag_ms)
        rows = time_window.assigned(df(self._data(rec)), window, spec.ts, lag_ms, rec.order, self.config.chunk_rows)
        return spec.result(rows)

    def _window_rule(self, sql: str, window: Window, ts: str | None, key: str | None, lag_ms: int) -> tuple[Record, Callable, WindowRule]:
        """A rule's record, what makes its rows of the record's data (lookups and
        the condition ``__pass``), and the aggregate over rows in their windows."""
        rec, query, _ = self._rule(sql)
        bounds(window)
        kinds = {c.name: (rec.places[c.name], c.kind) for c in rec.columns}
        if ts == CLOCK:
            kinds |= {CLOCK: ("__clock", LONG)}
        for name in (ts, key):
            if name is not None and name not in kinds:
                raise RuleError(f"no column {name} in {rec.name}")
        if ts is None or kinds[ts][1] != LONG:
            raise RuleError("event time is a whole-number column of milliseconds")
        fields = self._fields(query, kinds, F.col("__seq"), F.col("__pass") if key is None else None, False)
        self._distinct(list(fields), ["window_start_ms", "window_end_ms", "size" if key is None else "key"])

        def passed(data: DataFrame) -> DataFrame:
            scope = _Scope(data)
            where = self._binder(rec, scope).where(query.where)
            return scope.df.withColumn("__pass", where).select(*data.columns, "__pass")

        return rec, passed, WindowRule(window, kinds[ts][0], lag_ms, fields, key and kinds[key][0])

    def kind_of(self, aggregate: str) -> str:
        return result_kind(aggregate)
