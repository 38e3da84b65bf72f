"""The 16 aggregates as Column builders: value, condition, order.

Each takes the rows for which ``when`` holds (all, if None). Over no rows it
gives its initial value, never NULL. First and last go by the column ``order``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DOUBLE, LONG, RuleError

#: Initial values of least and greatest: the bounds of the types.
LONG_MAX, LONG_MIN, DOUBLE_MAX = 2**63 - 1, -(2**63), 1.7976931348623157e308

WHOLE = {"_suml", "_minl", "_maxl", "_firstl", "_lastl"}
FLOAT = {"_sumd", "_mind", "_maxd", "_firstd", "_lastd", "_avg", "_stddev", "_stddev_samp", "_variance", "_var_samp"}
AGGREGATES = WHOLE | FLOAT | {"_count"}


def result_kind(name: str) -> str:
    return DOUBLE if name in FLOAT else LONG


def build(name: str, value: Column, kind: str, order: Column, when: Column | None = None, newest_first: bool = False) -> Column:
    """``newest_first``: rows are delivered from the latest back, hence the
    first one is that of the greatest order."""
    if name in WHOLE and kind == DOUBLE:
        raise RuleError(f"{name} takes a whole-number column")
    x = value.cast("double") if name in FLOAT else value
    some = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    n = F.count(F.lit(1)) if when is None else F.count(F.when(when, 1))
    if name == "_count":
        return n
    if name in ("_suml", "_sumd"):
        return F.coalesce(F.sum(some(x)), F.lit(0).cast("long" if name == "_suml" else "double"))
    if name == "_avg":
        return F.coalesce(F.avg(some(x)), F.lit(0.0))
    if name == "_minl":
        return F.coalesce(F.min(some(x)), F.lit(LONG_MAX))
    if name == "_maxl":
        return F.coalesce(F.max(some(x)), F.lit(LONG_MIN))
    if name in ("_mind", "_maxd"):
        number = some(F.when(~F.isnan(x), x)) if kind == DOUBLE else some(x)
        # the initial value takes part: an infinite greatest value stays, a lesser bound does not
        return F.least(F.coalesce(F.min(number), F.lit(DOUBLE_MAX)), F.lit(DOUBLE_MAX)) if name == "_mind" else F.greatest(F.coalesce(F.max(number), F.lit(-DOUBLE_MAX)), F.lit(-DOUBLE_MAX))
    if name in ("_firstl", "_firstd", "_lastl", "_lastd"):
        pick = F.max_by if (name[1] == "l") != newest_first else F.min_by
        return F.coalesce(pick(x, some(order)), F.lit(0).cast("double" if name in FLOAT else "long"))
    spread = {"_stddev": F.stddev_pop, "_stddev_samp": F.stddev_samp, "_variance": F.var_pop, "_var_samp": F.var_samp}[name]
    return F.when(n > 1, F.coalesce(spread(some(x)), F.lit(0.0))).otherwise(0.0)
