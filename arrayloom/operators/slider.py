"""Sliding windows over a grid, and stitching of overlapping patches."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions.elementwise import NAN


class SlidingWindow:
    """Windows of a size over a shape; what to do is decided here, rows are made by frame().

    overlap (a share, 0 <= overlap < 1) or stride, not both; a window length of None is the whole axis. keepbound adds a
    last window that ends with the axis. A shape that the windows don't fill needs allow_overshoot.
    """

    def __init__(self, shape: tuple[int, ...], window: tuple[int | None, ...] | None = None, overlap=None, stride=None, keepbound: bool = False, allow_overshoot: bool = False) -> None:
        self.shape = tuple(shape)
        dims = len(self.shape)
        window = (None,) * dims if window is None else tuple(window)
        self.window = tuple(n if w is None else w for n, w in zip(self.shape, window, strict=True))
        self.stride, self.overlap = self._strides(overlap, stride, dims)
        over = [(n - w) % s != 0 or w > n for n, w, s in zip(self.shape, self.window, self.stride, strict=True)]
        if any(over) and not allow_overshoot:
            raise ValueError("windows don't fill the shape; allow_overshoot accepts that")
        self.starts = [self._axis(n, w, s, keepbound) for n, w, s in zip(self.shape, self.window, self.stride, strict=True)]

    def _strides(self, overlap, stride, dims: int) -> tuple[tuple[int, ...], tuple[float, ...]]:
        if (overlap is None) == (stride is None) and overlap is not None:
            raise ValueError("give overlap or stride, not both")
        if stride is None:
            share = overlap if isinstance(overlap, (list, tuple)) else [0 if overlap is None else overlap] * dims
            if any(not 0 <= f < 1 for f in share):
                raise ValueError("overlap must be at least 0 and less than 1")
            stride = [int(round(w - w * f)) for w, f in zip(self.window, share, strict=True)]
        stride = tuple(stride) if isinstance(stride, (list, tuple)) else (stride,) * dims
        if any(s <= 0 for s in stride):
            raise ValueError("a stride is 0")
        return stride, tuple(1 - s / w for s, w in zip(stride, self.window, strict=True))

    @staticmethod
    def _axis(n: int, w: int, s: int, keepbound: bool) -> list[int]:
        starts = list(range(0, max(n - w, 0) + 1, s))
        if keepbound and starts[-1] + w < n:
            starts.append(n - w)
        return starts

    @property
    def grid_shape(self) -> tuple[int, ...]:
        return tuple(map(len, self.starts))

    def __len__(self) -> int:
        return math.prod(self.grid_shape)

    def __getitem__(self, index: int) -> tuple[slice, ...]:
        if not -len(self) <= index < len(self):
            raise IndexError(index)
        index %= len(self)
        at = []
        for n in reversed(self.grid_shape):
            index, r = divmod(index, n)
            at.append(r)
        return tuple(slice(s[i], s[i] + w) for s, i, w in zip(self.starts, reversed(at), self.window, strict=True))

    def __iter__(self) -> Iterator[tuple[slice, ...]]:
        for starts in itertools.product(*self.starts):
            yield tuple(slice(a, a + w) for a, w in zip(starts, self.window, strict=True))

    slices = property(lambda self: list(self))

    @property
    def grid(self) -> Iterator[tuple[int, ...]]:
        return itertools.product(*map(range, self.grid_shape))

    @property
    def centers(self) -> Iterator[tuple[float, ...]]:
        for window in self:
            yield tuple(s.start + (s.stop - s.start - 1) / 2 for s in window)

    def frame(self, spark: SparkSession) -> DataFrame:
        """flat, then g, start, stop and center of each axis; windows are made by the executors, row by row of `flat`."""
        df = spark.range(len(self)).withColumnRenamed("id", "flat")
        below = len(self)
        for i, (n, starts, w) in enumerate(zip(self.grid_shape, self.starts, self.window, strict=True)):
            below //= n
            g = (F.floor(F.col("flat") / below) % n).cast("bigint")
            regular = F.least(g * self.stride[i], F.lit(starts[-1]))
            df = df.withColumns({f"g{i}": g, f"start{i}": regular.cast("bigint")})
            df = df.withColumns({f"stop{i}": F.col(f"start{i}") + w, f"center{i}": F.col(f"start{i}") + F.lit((w - 1) / 2)})
        return df

    def cover(self, cells: DataFrame, dims: list[str]) -> DataFrame:
        """Each cell with g of every window that it lies in: windows are computed from the cell, nothing is joined."""
        out = cells
        for i, d in enumerate(dims):
            w, s, n = self.window[i], self.stride[i], self.grid_shape[i]
            first = F.greatest(F.lit(0), F.ceil((F.col(d) - (w - 1)) / s)).cast("bigint")
            last = F.least(F.lit(n - 1), F.floor(F.col(d) / s)).cast("bigint")
            grid = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
            flush = self.starts[i][-1]
            if flush % s:  # the last window isn't on the grid of strides
                on_grid = F.filter(grid, lambda g: g < n - 1)  # noqa: B023  used at once
                grid = F.when((F.col(d) >= flush) & (F.col(d) < flush + w), F.concat(on_grid, F.array(F.lit(n - 1).cast("bigint")))).otherwise(on_grid)
            out = out.withColumn(f"g{i}", F.explode(grid)).withColumn(f"start{i}", F.least(F.col(f"g{i}") * s, F.lit(flush)))
        return out


def stitch(patches: DataFrame, dims: list[str], value: str = "v", weight: str | Column | None = None, nan_policy: str = "omit") -> DataFrame:
    """Weighted average of all values that patches give a cell: dims, v. Patches come as rows, one for each of their cells.

    omit: NaN has weight 0, and a cell without other values is NaN. propagate: NaN stays. raise: NaN is an error.
    """
    if nan_policy not in ("omit", "propagate", "raise"):
        raise KeyError(nan_policy)
    x = F.col(value).cast("double")
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    if nan_policy == "omit":
        w, x = F.when(F.isnan(x), 0.0).otherwise(w), F.nanvl(x, F.lit(0.0))
    elif nan_policy == "raise":
        x = F.when(F.isnan(x), F.raise_error(F.lit("NaN in a patch")).cast("double")).otherwise(x)
    sums = patches.groupBy(*dims).agg(F.sum(w * x).alias("_s"), F.sum(w).alias("_w"))
    return sums.select(*dims, F.when(F.col("_w") == 0, NAN).otherwise(F.col("_s") / F.when(F.col("_w") != 0, F.col("_w"))).alias("v"))


def placed(patch: DataFrame, dims: list[str], starts: list[int]) -> DataFrame:
    """A patch whose cells count from 0, moved to where its slice of the whole begins; a union of such is what stitch takes."""
    return patch.withColumns({d: F.col(d) + F.lit(s) for d, s in zip(dims, starts, strict=True)})


def region(stitched: DataFrame, dims: list[str], slices: list[tuple[int, int]]) -> DataFrame:
    """The cells of a slice of what was stitched, counted from the slice's beginning."""
    for d, (low, high) in zip(dims, slices, strict=True):
        stitched = stitched.where((F.col(d) >= low) & (F.col(d) < high)).withColumn(d, F.col(d) - F.lit(low))
    return stitched


def stitch_grid(patches: DataFrame, shape: tuple[int, ...], value: str = "v", weight=None, nan_policy: str = "omit") -> DataFrame:
    """stitch over a whole grid with dims d0, d1, ...; cells without a patch are NaN."""
    from arrayloom.operators.tensor import Tensor

    dims = [f"d{i}" for i in range(len(shape))]
    grid = Tensor.full(patches.sparkSession, shape, 0).df.drop("v")
    return grid.join(stitch(patches, dims, value, weight, nan_policy), dims, "left").withColumn("v", F.coalesce("v", F.lit(NAN)))
