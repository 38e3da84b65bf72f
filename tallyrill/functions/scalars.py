"""The 22 scalar functions as Column builders.

Values are never NULL; integer arithmetic wraps; floats follow IEEE 754, where
Spark's own functions give NULL, errors or another order of NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, DOUBLE, LONG, RuleError

Typed = tuple[Column, str]


def double(x: Typed) -> Column:
    return x[0].cast("double")


def both(a: Typed, b: Typed) -> tuple[Column, Column, str]:
    """Two operands in their common type."""
    if BOOL in (a[1], b[1]):
        raise RuleError("a truth value is no operand here")
    if a[1] == b[1] == LONG:
        return a[0], b[0], LONG
    return double(a), double(b), DOUBLE


def add(a: Typed, b: Typed) -> Typed:
    x, y, kind = both(a, b)
    return x + y, kind


def sub(a: Typed, b: Typed) -> Typed:
    x, y, kind = both(a, b)
    return x - y, kind


def mul(a: Typed, b: Typed) -> Typed:
    x, y, kind = both(a, b)
    return x * y, kind


def div(a: Typed, b: Typed) -> Typed:
    """Whole numbers: cut toward zero, by zero gives 0. Floats: IEEE."""
    x, y, kind = both(a, b)
    if kind == LONG:
        return F.when(y == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", x, y)), LONG
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    minus = (x < 0) != (y.cast("string") == "-0.0")
    by_zero = F.when(F.isnan(x) | (x == 0), nan).when(minus, -inf).otherwise(inf)
    return F.when(y == 0, by_zero).otherwise(x / y), DOUBLE


def mod(a: Typed, b: Typed) -> Typed:
    """Whole numbers: sign of the dividend, by zero gives 0. A float gives 0."""
    x, y, kind = both(a, b)
    zero = F.lit(0).cast("long")
    return (zero, LONG) if kind == DOUBLE else (F.when(y == 0, zero).otherwise(x % y), LONG)


def absolute(a: Typed) -> Typed:
    return F.abs(a[0]), a[1]


def _whole(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    """Rounding of floats to floats; large numbers, zeros and NaN are whole
    already, and what rounds to zero keeps its sign."""

    def build(a: Typed) -> Typed:
        x = a[0]
        if a[1] == LONG:
            return a
        r = f(x).cast("double")
        return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52) | (x == 0), x).when((x < 0) & (r == 0), -0.0).otherwise(r), DOUBLE

    return build


ceil, floor = _whole(F.ceil), _whole(F.floor)
truncate = _whole(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
nearest = _whole(lambda x: F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)))


def sign(a: Typed) -> Typed:
    """Whole numbers: -1, 0, 1. Floats: the sign bit as 1.0 or -1.0, NaN for NaN."""
    x = a[0]
    if a[1] == LONG:
        return F.signum(x).cast("long"), LONG
    zero = F.when(x.cast("string") == "-0.0", -1.0).otherwise(1.0)
    return F.when(x == 0, zero).otherwise(F.signum(x)), DOUBLE


def _logarithm(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    def build(a: Typed) -> Typed:
        x = double(a)
        return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(f(x)), DOUBLE

    return build


def _float(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    return lambda a: (f(double(a)), DOUBLE)


def power(a: Typed, b: Typed) -> Typed:
    """One to any power is one, NaN included; so is the power of zero."""
    x, y = double(a), double(b)
    return F.when((x == 1.0) | (y == 0), 1.0).otherwise(F.pow(x, y)), DOUBLE


def _extreme(f: Callable[..., Column]) -> Callable[[Typed, Typed], Typed]:
    """Of two floats a NaN is passed over."""

    def build(a: Typed, b: Typed) -> Typed:
        x, y, kind = both(a, b)
        if kind == LONG:
            return f(x, y), LONG
        return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(f(x, y)), DOUBLE

    return build


def to_long(a: Typed) -> Typed:
    """Cut toward zero; beyond 64 bits the nearest bound, NaN gives 0."""
    return a[0].cast("long"), LONG


SCALARS: dict[str, tuple[int, Callable[..., Typed]]] = {
    "_add": (2, add), "_sub": (2, sub), "_mul": (2, mul), "_div": (2, div), "_mod": (2, mod),
    "_abs": (1, absolute), "_ceil": (1, ceil), "_floor": (1, floor), "_round": (1, nearest), "_trunc": (1, truncate), "_sign": (1, sign),
    "_sqrt": (1, _float(F.sqrt)), "_exp": (1, _float(F.exp)), "_ln": (1, _logarithm(F.ln)), "_log10": (1, _logarithm(F.log10)),
    "_to_long": (1, to_long), "_to_double": (1, lambda a: (double(a), DOUBLE)), "_pow": (2, power),
    "_greatest": (2, _extreme(F.greatest)), "_least": (2, _extreme(F.least)),
}
#: Functions over dimensions; their first argument is a whole-number literal.
DIMENSION_FUNCTIONS = ("_dim_has", "_dim_get")


def compare(op: str, a: Typed, b: Typed) -> Column:
    """Whole numbers as such, else as floats, where NaN compares false with all."""
    if (a[1] == BOOL) != (b[1] == BOOL) and DOUBLE in (a[1], b[1]):
        raise RuleError("a truth value cannot be compared with a float")
    a, b = ((x[0].cast("long"), LONG) if x[1] == BOOL else x for x in (a, b))
    x, y, kind = both(a, b)
    out = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if kind == LONG:
        return out
    floats = [v for v, t in ((x, a[1]), (y, b[1])) if t == DOUBLE]
    for v in floats:
        out = out & ~F.isnan(v)
    return out
