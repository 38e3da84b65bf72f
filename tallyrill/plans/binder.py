"""Names and types: syntax trees to Columns."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..functions.aggregates import AGGREGATES
from ..functions.scalars import DIMENSION_FUNCTIONS, SCALARS, Typed, compare
from ..types import BOOL, DOUBLE, LONG, Column, RuleError
from .dialect import Binary, Call, Item, Name, Negative, Number, Query, Truth

log = logging.getLogger("tallyrill")


class Binder:
    """Binds the expressions of one rule to a record's columns. ``lookup`` gives
    the two columns (has, value) for a dimension id and a key; ``places`` the
    names under which the data holds the record's columns."""

    def __init__(self, record: str, columns: list[Column], lookup: Callable[[int, SparkColumn], tuple[SparkColumn, SparkColumn]] | None = None, places: dict[str, str] | None = None):
        self.record, self.columns, self.lookup = record, {c.name: c for c in columns}, lookup
        self.places = places or {c.name: c.name for c in columns}

    def column(self, name: Name) -> Typed:
        if name.record is not None and name.record != self.record:
            raise RuleError(f"{name.record} is not the record of this rule")
        if name.name not in self.columns:  # exact: names are case-sensitive
            raise RuleError(f"no column {name.name} in {self.record}")
        return F.col(f"`{self.places[name.name]}`"), self.columns[name.name].kind

    def expr(self, e) -> Typed:
        if isinstance(e, Number):
            return (F.lit(e.value).cast("long"), LONG) if isinstance(e.value, int) else (F.lit(e.value), DOUBLE)
        if isinstance(e, Truth):
            return F.lit(e.value), BOOL
        if isinstance(e, Name):
            return self.column(e)
        if isinstance(e, Negative):
            x, kind = self.expr(e.arg)
            if kind == BOOL:
                raise RuleError("a truth value has no negative")
            return -x, kind
        if isinstance(e, Call):
            return self.call(e)
        if isinstance(e, Binary) and e.op in ("AND", "OR"):
            (a, ka), (b, kb) = self.expr(e.left), self.expr(e.right)
            if ka == kb == BOOL:
                return (a & b if e.op == "AND" else a | b), BOOL
            if DOUBLE in (ka, kb):
                raise RuleError(f"{e.op} takes conditions")
            a, b = a.cast("long"), b.cast("long")
            return (a.bitwiseAND(b) if e.op == "AND" else a.bitwiseOR(b)) == 1, BOOL
        if isinstance(e, Binary):
            return compare(e.op, self.expr(e.left), self.expr(e.right)), BOOL
        raise RuleError(f"cannot bind {e}")

    def call(self, e: Call) -> Typed:
        if e.name in DIMENSION_FUNCTIONS:
            if len(e.args) != 2 or not isinstance(e.args[0], Number) or not isinstance(e.args[0].value, int):
                raise RuleError(f"{e.name} takes a dimension id and a key")
            key = self.expr(e.args[1])[0].cast("long")
            has, value = self.lookup(e.args[0].value, key)
            return (has if e.name == "_dim_has" else value), LONG
        if e.name in AGGREGATES:
            raise RuleError(f"{e.name} is an aggregate; here a value of one row is asked for")
        if e.name not in SCALARS:
            raise RuleError(f"no function {e.name}")
        n, build = SCALARS[e.name]
        if len(e.args) != n:
            raise RuleError(f"{e.name} takes {n} arguments, not {len(e.args)}")
        args = [self.expr(a) for a in e.args]
        if any(k == BOOL for _, k in args):
            raise RuleError(f"{e.name} takes numbers")
        return build(*args)

    def where(self, e) -> SparkColumn:
        """The condition of a rule. One that is no truth value lets nothing pass."""
        if e is None:
            return F.lit(True)
        c, kind = self.expr(e)
        if kind != BOOL:
            log.warning("a WHERE that is no condition lets nothing pass")
            return F.lit(False)
        return c

    def named(self, query: Query) -> list[tuple[str, SparkColumn, str]]:
        """Output columns of a plain rule: name, Column, type."""
        out = []
        for k, item in enumerate(query.items):
            c, kind = self.expr(item.expr)
            out.append((field_name(item, k), c.cast("long") if kind == BOOL else c, LONG if kind == BOOL else kind))
        names = [n for n, _, _ in out]
        if len(set(names)) < len(names):
            raise RuleError(f"two output columns of one name among {names}; use AS")
        return out


def field_name(item: Item, k: int) -> str:
    return item.alias or (item.expr.name if isinstance(item.expr, Name) else f"f{k}")
