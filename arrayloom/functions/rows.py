"""Functions of array columns, for vectors that live within a row. Everything stays in the JVM; indices count from 0."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from arrayloom.functions.elementwise import NAN, _c, source_place


def indices(a) -> Column:
    """0 to size - 1; empty for an empty array."""
    n = F.size(_c(a))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def numel(a) -> Column:
    return F.size(_c(a)).cast("bigint")


def take(a, where) -> Column:
    """Gather in the order given; beyond the ends is NULL."""
    a = _c(a)
    return F.transform(where if isinstance(where, Column) else F.array(*[F.lit(i) for i in where]), lambda i: F.get(a, i))


def compress(a, flags) -> Column:
    """Elements whose flag is true."""
    return F.transform(F.filter(F.arrays_zip(_c(a).alias("x"), _c(flags).alias("keep")), lambda p: p["keep"]), lambda p: p["x"])


def repeat(a, n: int) -> Column:
    """Each element n times."""
    return F.flatten(F.transform(_c(a), lambda x: F.array_repeat(x, n)))


def tile(a, n: int) -> Column:
    """The whole array n times."""
    return F.flatten(F.array_repeat(_c(a), n))


def cat(*arrays) -> Column:
    return F.concat(*[_c(a) for a in arrays])


def reverse(a) -> Column:
    return F.reverse(_c(a))


def full_like(a, value) -> Column:
    return F.transform(_c(a), lambda x: F.lit(value))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def full(n: int, value) -> Column:
    return F.array_repeat(F.lit(value), n)


empty = zeros  # there is no memory to leave unset


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def maximum(a) -> Column:
    """NaN if an element is."""
    return F.array_max(_c(a))


def minimum(a) -> Column:
    """NaN if an element is."""
    a = _c(a)
    return F.when(F.exists(a, F.isnan), NAN).otherwise(F.array_min(a).cast("double"))


def _ranked(a, down: bool) -> Column:
    a = _c(a)
    pairs = F.transform(a, lambda x, i: F.struct((-x if down else x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def argsort(a, descending: bool = False) -> Column:
    """Stable ascending order; descending is that order reversed."""
    out = _ranked(a, False)
    return F.reverse(out) if descending else out


def argmax(a) -> Column:
    """The first maximum; the first NaN, if there is one."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a) -> Column:
    """The first minimum; the first NaN, if there is one."""
    a = _c(a)
    nan = F.array_position(F.transform(a, F.isnan), F.lit(True))
    return F.when(nan > 0, nan - 1).otherwise(F.array_position(a, F.array_min(a)) - 1).cast("int")


def argmaxima(a, k: int) -> Column:
    """Places of the k largest, largest first, ties by place."""
    if k < 0:
        raise IndexError("k is negative")
    return F.slice(_ranked(a, True), 1, k)


def argminima(a, k: int) -> Column:
    if k < 0:
        raise IndexError("k is negative")
    return F.slice(_ranked(a, False), 1, k)


def nonzero(a) -> Column:
    a = _c(a)
    return F.filter(indices(a), lambda i: F.get(a, i) != 0)


def any_true(a) -> Column:
    return F.exists(_c(a), lambda x: x != 0)


def all_true(a) -> Column:
    return F.forall(_c(a), lambda x: x != 0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def minkowski(a, b, p: float = 2) -> Column:
    parts = F.zip_with(_c(a), _c(b), lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(float(p))))
    return F.pow(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0 / p))


def softmax(a) -> Column:
    a = _c(a)
    e = _bound(F.array_max(a).cast("double"), a, lambda top, all_: F.transform(all_, lambda x: F.exp(x.cast("double") - top)))
    return _bound(F.lit(0.0), e, lambda zero, all_: _bound(F.aggregate(all_, zero, lambda s, y: s + y), all_, lambda below, same: F.transform(same, lambda x: x / below)))


def _bound(value: Column, array: Column, fn) -> Column:
    """fn(value, array) with both computed once for a row, not once for each element of the array."""
    once = F.array(F.struct(value.alias("v"), array.alias("a")))
    return F.get(F.transform(once, lambda s: fn(s["v"], s["a"])), F.lit(0))


def clip(a, low: float, high: float) -> Column:
    return F.transform(_c(a), lambda x: F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high))))


def isect_flags(a, other: list) -> Column:
    values = F.array(*[F.lit(x) for x in other])
    return F.transform(_c(a), lambda x: F.array_contains(values, x)) if other else F.transform(_c(a), lambda x: F.lit(False))


def boolmask(where, n: int | None = None) -> Column:
    """True at the given places of an array of length n, or of the last place plus one."""
    where = _c(where)
    size = F.lit(n) if n is not None else F.coalesce(F.array_max(where) + 1, F.lit(0))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.array_contains(where, i.cast("int")))).otherwise(F.array().cast("array<boolean>"))


def pad(a, before: int, after: int, mode: str = "constant", value=0) -> Column:
    """Pad by a constant, the edge, a reflection without (reflect) or with the edge (symmetric), by wrapping round, or by
    the mean, maximum or minimum."""
    a = _c(a)
    if mode == "constant":
        return _surrounded(a, F.lit(before), F.lit(after), F.lit(value))
    return _padded(a, F.lit(before), F.lit(after), mode)


def _surrounded(a: Column, before: Column, after: Column, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, before), a, F.array_repeat(fill, after))


def _padded(a: Column, before: Column, after: Column, mode: str) -> Column:
    n = F.size(a)
    if mode in ("mean", "maximum", "minimum"):
        fill = {"mean": total(a) / n, "maximum": F.array_max(a), "minimum": F.array_min(a)}[mode]
        return _surrounded(a, before, after, fill)
    return F.transform(F.sequence(-before, n + after - 1), lambda i: F.get(a, source_place(i, n, mode).cast("int")))


def padded_slice(a, start: int, stop: int, before: int = 0, after: int = 0, mode: str = "constant", value=0) -> Column:
    """a[start - before : stop + after], where places outside the array are padding and don't count from its end."""
    a = _c(a)
    n = F.size(a)
    low, high = start - before, stop + after
    if low > high:
        raise ValueError("the slice ends before it starts")
    inside_low, inside_high = F.least(F.greatest(F.lit(low), F.lit(0)), n), F.least(F.greatest(F.lit(high), F.lit(0)), n)
    left = F.least(F.lit(high), F.lit(0)) - F.least(F.lit(low), F.lit(0))
    right = F.greatest(F.lit(high), n) - F.greatest(F.lit(low), n)
    inner = F.slice(a, inside_low + 1, F.greatest(inside_high - inside_low, F.lit(0)))
    if mode == "constant":
        fill = F.lit(value)
        return F.concat(F.array_repeat(fill, left), inner, F.array_repeat(fill, right))
    return _padded(inner, left, right, mode)


def one_hot(label, classes: int) -> Column:
    """A vector with 1.0 at the label; a negative label counts from the end, another one outside raises."""
    label = _c(label)
    place = F.when((label < -classes) | (label >= classes), F.raise_error(F.lit("label outside the classes")).cast("int")).otherwise(F.pmod(label, F.lit(classes)))
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == place, 1.0).otherwise(0.0))


def one_hot_lookup(a, index) -> Column:
    return F.get(_c(a), _c(index).cast("int"))


def gmean(a) -> Column:
    """exp(mean(log)); 0 if an element is 0, NaN if one is negative."""
    a = _c(a)
    n = F.size(a)
    logs = F.aggregate(F.transform(a, lambda x: F.ln(F.when(x > 0, x.cast("double")))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.exists(a, lambda x: F.isnan(x) | (x < 0)), NAN).when(F.exists(a, lambda x: x == 0), 0.0).when(n == 0, NAN).otherwise(F.exp(logs / n))


def atleast_nd(a, depth: int, n: int, front: bool = False) -> Column:
    """Unit axes around an array of the given depth, until it has n axes."""
    out = _c(a)
    for _ in range(max(0, n - depth)):
        out = F.array(out) if front or depth == 0 else F.transform(out, F.array) if depth == 1 else F.transform(out, lambda x: F.transform(x, F.array))
        depth += 1
    return out


__all__ = [x for x in dir() if not x.startswith("_") and x not in ("annotations", "Column", "F", "NAN")]
