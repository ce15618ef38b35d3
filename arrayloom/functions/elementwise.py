"""Element-wise functions of columns with array semantics: NaN is a value, NULL never arises, division by zero is infinite."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = math.nan, math.inf
_C = Column | str


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def divide(a: _C, b: _C) -> Column:
    """a / b with 0/0 = NaN and x/0 = an infinity."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)


def _log(fn, x: _C) -> Column:
    x = _c(x).cast("double")
    return F.when(x > 0, fn(F.when(x > 0, x))).when(x == 0, -INF).otherwise(NAN)  # NaN is greater than all numbers


def log(x: _C) -> Column:
    return _log(F.ln, x)


def log2(x: _C) -> Column:
    return _log(F.log2, x)


def log10(x: _C) -> Column:
    return _log(F.log10, x)


def sqrt(x: _C) -> Column:
    return F.sqrt(_c(x).cast("double"))


def _finite(x: Column, rounded: Column) -> Column:
    """Infinities and NaN have no integer part: they stay."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(rounded.cast("double"))


def floor(x: _C) -> Column:
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(2.0**53)), x).otherwise(F.floor(F.when(F.abs(x) < F.lit(2.0**53), x)).cast("double"))


def ceil(x: _C) -> Column:
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(2.0**53)), x).otherwise(F.ceil(F.when(F.abs(x) < F.lit(2.0**53), x)).cast("double"))


def ifloor(x: _C) -> Column:
    return F.floor(_c(x)).cast("int")


def iceil(x: _C) -> Column:
    return F.ceil(_c(x)).cast("int")


def round_even(x: _C, decimals: int = 0) -> Column:
    """Half to even."""
    return F.rint(_c(x)) if decimals == 0 else F.rint(_c(x) * F.lit(10.0**decimals)) / F.lit(10.0**decimals)


def iround(x: _C, kind: str = "bigint") -> Column:
    return F.rint(_c(x)).cast(kind)


def trunc(x: _C) -> Column:
    x = _c(x).cast("double")
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def clip(x: _C, low=None, high=None) -> Column:
    """Clamp; NaN stays NaN."""
    x = out = _c(x)
    out = out if low is None else F.greatest(out, _c(low))
    out = out if high is None else F.least(out, _c(high))
    return F.when(F.isnan(x), x).otherwise(out)


def maximum(a: _C, b: _C) -> Column:
    """The larger; NaN if either is."""
    return F.greatest(_c(a), _c(b))


def minimum(a: _C, b: _C) -> Column:
    """The smaller; NaN if either is."""
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a) | F.isnan(b), NAN).otherwise(F.least(a, b))


def isclose(a: _C, b: _C, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    """abs(a - b) <= atol + rtol * abs(b); equal infinities are close, NaN only if asked."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    nan = F.isnan(a) | F.isnan(b)
    infinite = (F.abs(a) == INF) | (F.abs(b) == INF)
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(nan, (F.isnan(a) & F.isnan(b)) if equal_nan else F.lit(False)).when(infinite, a == b).otherwise(near)


def equal_with_nan(a: _C, b: _C, literal: bool = False) -> Column:
    """Equality under which NaN equals NaN. literal: equal plainly, or both NaN, but not both or neither of these."""
    a, b = _c(a), _c(b)
    if not literal:
        return a.eqNullSafe(b)
    plain = ~F.isnan(a) & ~F.isnan(b) & (a == b)
    return plain != (F.isnan(a) == F.isnan(b))


def nan_to_num(x: _C, infinite: bool = True) -> Column:
    """NaN to 0 and, if asked, infinities to the largest finite numbers."""
    x = F.nanvl(_c(x).cast("double"), F.lit(0.0))
    big = F.lit(1.7976931348623157e308)
    return F.when(x == INF, big).when(x == -INF, -big).otherwise(x) if infinite else x


def astype(x: _C, kind: str) -> Column:
    """Cast; floats are cut towards zero. What the type can't hold is NULL."""
    return _c(x).try_cast(kind)


def isect_flags(x: _C, other: list) -> Column:
    """Whether x is among other; of an empty list nothing is."""
    return _c(x).isin(list(other)) if len(other) else F.lit(False)


def generalized_logistic(x: _C, floor: float = 0, capacity: float = 1, C: float = 1, y_intercept: float | None = None, Q: float | None = None, growth: float = 1, v: float = 1) -> Column:  # noqa: N803
    """Richards' curve A + (K - A) / (C + Q exp(-growth x)) ** (1 / v); Q or the value at 0 fixes the shift."""
    if Q is not None and y_intercept is not None:
        raise ValueError("give Q or y_intercept, not both")
    if Q is None:
        Q = 1 if y_intercept is None else ((capacity - floor) / (y_intercept - floor)) ** v - C  # noqa: N806
    return F.lit(floor) + F.lit(capacity - floor) / F.pow(F.lit(C) + F.lit(Q) * F.exp(-F.lit(float(growth)) * _c(x).cast("double")), F.lit(1.0 / v))


def fold(fn, columns: list[_C], default=None) -> Column:
    """A binary function over columns from left to right; of none, the default."""
    if not columns:
        return F.lit(default)
    out = _c(columns[0])
    for x in columns[1:]:
        out = fn(out, _c(x))
    return out


def source_place(at: Column, n: Column, mode: str) -> Column:
    """Which of the places 0 to n - 1 stands at a place outside them: the nearest one (edge), a reflection without or with
    the ends (reflect, symmetric), or the places over again (wrap)."""
    if mode == "edge":
        return F.least(F.greatest(at, F.lit(0)), n - 1)
    if mode == "wrap":
        return F.pmod(at, n)
    if mode == "reflect":
        turn = F.greatest(2 * (n - 1), F.lit(1))
        there = F.pmod(at, turn)
        return F.when(there < n, there).otherwise(turn - there)
    if mode == "symmetric":
        there = F.pmod(at, 2 * n)
        return F.when(there < n, there).otherwise(2 * n - 1 - there)
    raise ValueError(f"unknown mode {mode}")
