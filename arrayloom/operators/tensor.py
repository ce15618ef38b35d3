"""n-dimensional arrays as frames with one row per cell: index columns, and a value column.

Shapes are known when a tensor is made; operations are joins and aggregations on index columns, so nothing but a reduced
result ever meets in one place. Row order means nothing: order is in the index columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrayloom.functions.elementwise import NAN, isclose as _isclose
from arrayloom.functions.elementwise import source_place
from arrayloom.sources.frames import with_positions


class Tensor:
    """df: index columns d0, d1, ... (bigint) and v; shape: the length of each axis."""

    def __init__(self, df: DataFrame, shape: tuple[int, ...]) -> None:
        self.shape = tuple(int(n) for n in shape)
        self.dims = [f"d{i}" for i in range(len(self.shape))]
        self.df = df.select(*[F.col(d).cast("bigint").alias(d) for d in self.dims], "v")

    # making and leaving

    @classmethod
    def from_numpy(cls, spark: SparkSession, data) -> Tensor:
        data = np.asarray(data)
        cells = [(*map(int, at), x.item()) for at, x in np.ndenumerate(data)]
        kind = {"i": "bigint", "u": "bigint", "b": "boolean", "f": "double"}[data.dtype.kind]
        dims = [f"d{i}" for i in range(data.ndim)]
        return cls(spark.createDataFrame(cells, ", ".join([f"{d} bigint" for d in dims] + [f"v {kind}"])), data.shape)

    @classmethod
    def from_rows(cls, df: DataFrame, row: str, array: str, shape: tuple[int, int]) -> Tensor:
        """Rows of a matrix from an array column."""
        return cls(df.select(F.col(row).alias("d0"), F.posexplode(array).alias("d1", "v")), shape)

    @classmethod
    def full(cls, spark: SparkSession, shape: tuple[int, ...], value) -> Tensor:
        return cls._unravelled(spark.range(math.prod(shape)).select(F.col("id").alias("flat"), F.lit(value).alias("v")), shape)

    @classmethod
    def zeros(cls, spark: SparkSession, shape: tuple[int, ...]) -> Tensor:
        return cls.full(spark, shape, 0.0)

    @classmethod
    def ones(cls, spark: SparkSession, shape: tuple[int, ...]) -> Tensor:
        return cls.full(spark, shape, 1.0)

    empty = zeros  # there is no memory to leave unset

    @classmethod
    def _unravelled(cls, flat: DataFrame, shape: tuple[int, ...]) -> Tensor:
        cols, below = [], math.prod(shape)
        for i, n in enumerate(shape):
            below //= max(n, 1)
            cols.append((F.floor(F.col("flat") / F.lit(below)) % F.lit(max(n, 1))).cast("bigint").alias(f"d{i}"))
        return cls(flat.select(*cols, "v"), shape)

    def numpy(self) -> np.ndarray:
        """Bring a result that fits the driver there."""
        rows = self.df.toPandas()
        if not self.shape:
            return rows["v"].to_numpy()[0]
        kind = rows["v"].dtype if len(rows) else float
        out = np.zeros(self.shape, kind)
        out[tuple(rows[d].to_numpy() for d in self.dims)] = rows["v"].to_numpy()
        return out

    def tolist(self) -> list:
        return self.numpy().tolist()

    # shape

    @property
    def ndim(self) -> int:
        return len(self.shape)

    def numel(self) -> int:
        return math.prod(self.shape)

    def _axis(self, axis: int) -> int:
        if not -self.ndim <= axis < self.ndim:
            raise IndexError(f"no axis {axis} of {self.ndim}")
        return axis % self.ndim

    def flat(self) -> Column:
        """The row-major number of a cell."""
        out = F.lit(0).cast("bigint")
        for d, n in zip(self.dims, self.shape, strict=True):
            out = out * F.lit(n) + F.col(d)
        return out

    def map(self, fn: Callable[[Column], Column]) -> Tensor:
        return Tensor(self.df.withColumn("v", fn(F.col("v"))), self.shape)

    def astype(self, kind: str) -> Tensor:
        return self.map(lambda v: v.try_cast(kind))

    def transpose(self, axes: tuple[int, ...] | None = None) -> Tensor:
        axes = tuple(range(self.ndim))[::-1] if axes is None else tuple(self._axis(a) for a in axes)
        return Tensor(self.df.select(*[F.col(f"d{a}").alias(f"d{i}") for i, a in enumerate(axes)], "v"), tuple(self.shape[a] for a in axes))

    T = property(transpose)

    def view(self, *shape: int) -> Tensor:
        """The same cells in row-major order under another shape; one length may be -1."""
        shape = tuple(shape[0]) if len(shape) == 1 and isinstance(shape[0], (tuple, list)) else shape
        known = math.prod(n for n in shape if n != -1)
        shape = tuple(self.numel() // max(known, 1) if n == -1 else n for n in shape)
        if math.prod(shape) != self.numel():
            raise ValueError(f"{self.shape} can't be viewed as {shape}")
        return self._unravelled(self.df.select(self.flat().alias("flat"), "v"), shape)

    def atleast_nd(self, n: int, front: bool = False) -> Tensor:
        more = max(0, n - self.ndim)
        shape = (1,) * more + self.shape if front else self.shape + (1,) * more
        at = more if front else 0
        cols = {f"d{i}": F.lit(0).cast("bigint") for i in range(len(shape))} | {f"d{i + at}": F.col(d) for i, d in enumerate(self.dims)}
        return Tensor(self.df.select(*[c.alias(k) for k, c in cols.items()], "v"), shape)

    def take(self, indices: list[int], axis: int | None = None) -> Tensor:
        """Gather in the order given, repeats allowed; without an axis from the flattened tensor."""
        if axis is None:
            return self.view(-1).take(indices, 0)
        axis = self._axis(axis)
        n = self.shape[axis]
        spark = self.df.sparkSession
        picked = spark.createDataFrame([(i % n if -n <= i < n else None, k) for k, i in enumerate(indices)], "at bigint, ord bigint")
        if any(not -n <= i < n for i in indices):
            raise IndexError("index out of range")
        df = self.df.withColumnRenamed(f"d{axis}", "at").join(F.broadcast(picked), "at").withColumnRenamed("ord", f"d{axis}")  # a literal list
        return Tensor(df, tuple(len(indices) if i == axis else m for i, m in enumerate(self.shape)))

    def compress(self, flags: list[bool], axis: int | None = None) -> Tensor:
        return self.take([i for i, f in enumerate(flags) if f], axis)

    def repeat(self, n: int, axis: int) -> Tensor:
        """Each slice n times in a row."""
        axis = self._axis(axis)
        d = f"d{axis}"
        df = self.df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(d, F.col(d) * n + F.col("k")) if n else self.df.limit(0)
        return Tensor(df, tuple(m * n if i == axis else m for i, m in enumerate(self.shape)))

    def tile(self, reps: tuple[int, ...]) -> Tensor:
        out = self.atleast_nd(len(reps), front=True)
        reps = (1,) * (out.ndim - len(reps)) + tuple(reps)
        df = out.df
        for d, n, m in zip(out.dims, out.shape, reps, strict=True):
            df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn(d, F.col(d) + F.col("k") * n) if m else df.limit(0)
        return Tensor(df, tuple(n * m for n, m in zip(out.shape, reps, strict=True)))

    def pad(self, widths: list[tuple[int, int]], value=0, mode: str = "constant") -> Tensor:
        """A constant round the tensor, or what stands at the nearest (edge), reflected (reflect, symmetric) or wrapped place."""
        shape = tuple(n + a + b for n, (a, b) in zip(self.shape, widths, strict=True))
        grid = Tensor.full(self.df.sparkSession, shape, 0).df.drop("v")
        for i, (n, (a, _)) in enumerate(zip(self.shape, widths, strict=True)):
            place = F.col(f"d{i}") - a
            grid = grid.withColumn(f"s{i}", place if mode == "constant" else source_place(place, F.lit(n), mode).cast("bigint"))
        cells = self.df.select(*[F.col(d).alias(f"s{i}") for i, d in enumerate(self.dims)], F.col("v").alias("inner"))
        joined = grid.join(cells, [f"s{i}" for i in range(self.ndim)], "left")
        return Tensor(joined.withColumn("v", F.coalesce("inner", F.lit(value)) if mode == "constant" else F.col("inner")), shape)

    def one_hot(self, classes: int, axis: int = -1) -> Tensor:
        """1.0 where the new axis has the cell's label, else 0.0; a negative label counts from the end."""
        axis = axis % (self.ndim + 1)
        label = F.col("v").cast("bigint")
        label = F.when((label < -classes) | (label >= classes), F.raise_error(F.lit("label outside the classes")).cast("bigint")).otherwise(F.pmod(label, F.lit(classes)))
        cells = self.df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(classes - 1).cast("bigint"))))
        dims = [F.col(f"d{i}") for i in range(self.ndim)]
        dims.insert(axis, F.col("k"))
        shape = list(self.shape)
        shape.insert(axis, classes)
        return Tensor(cells.select(*[c.alias(f"d{i}") for i, c in enumerate(dims)], F.when(F.col("k") == label, 1.0).otherwise(0.0).alias("v")), tuple(shape))

    def full_like(self, value) -> Tensor:
        return self.map(lambda v: F.lit(value))

    def zeros_like(self) -> Tensor:
        return self.full_like(0.0)

    def ones_like(self) -> Tensor:
        return self.full_like(1.0)

    empty_like = zeros_like

    # reductions

    def _by(self, axis: int | tuple[int, ...] | None) -> tuple[list[str], list[str]]:
        """Index columns that stay, and those that go."""
        axes = range(self.ndim) if axis is None else [self._axis(a) for a in ((axis,) if isinstance(axis, int) else axis)]
        gone = [f"d{a}" for a in axes]
        return [d for d in self.dims if d not in gone], gone

    def reduce(self, agg: Callable[[Column], Column], axis: int | tuple[int, ...] | None = None) -> Tensor:
        kept, _ = self._by(axis)
        df = self.df.groupBy(*kept).agg(agg(F.col("v")).alias("v"))
        return Tensor(df.select(*[F.col(d).alias(f"d{i}") for i, d in enumerate(kept)], "v"), tuple(self.shape[int(d[1:])] for d in kept))

    def sum(self, axis=None) -> Tensor:
        return self.reduce(F.sum, axis)

    def max(self, axis=None) -> Tensor:
        return self.reduce(F.max, axis)

    def min(self, axis=None) -> Tensor:
        """NaN if a cell is."""
        return self.reduce(lambda v: F.when(F.bool_or(F.isnan(v)), NAN).otherwise(F.min(v)), axis)

    def any(self, axis=None) -> Tensor:
        return self.reduce(lambda v: F.bool_or(v != 0), axis)

    def all(self, axis=None) -> Tensor:
        return self.reduce(lambda v: F.bool_and(v != 0), axis)

    def _extreme(self, axis: int | None, largest: bool) -> DataFrame:
        kept, gone = self._by(axis)
        place = self.flat() if axis is None else F.col(gone[0])
        if largest:
            best = F.max(F.struct("v", (-place).alias("p")))
            df = self.df.groupBy(*kept).agg(best.alias("b")).select(*kept, F.col("b.v").alias("v"), (-F.col("b.p")).alias("at"))
        else:
            best = F.min(F.struct((~F.isnan("v")).alias("number"), "v", place.alias("p")))
            df = self.df.groupBy(*kept).agg(best.alias("b")).select(*kept, F.col("b.v").alias("v"), F.col("b.p").alias("at"))
        return df

    def max_argmax(self, axis: int | None = None) -> tuple[Tensor, Tensor]:
        """Maxima and the place of the first of each; NaN is larger than any number."""
        return self._both(axis, True)

    def min_argmin(self, axis: int | None = None) -> tuple[Tensor, Tensor]:
        """Minima and the place of the first of each; NaN wins here too."""
        return self._both(axis, False)

    def _both(self, axis: int | None, largest: bool) -> tuple[Tensor, Tensor]:
        kept, _ = self._by(axis)
        df = self._extreme(axis, largest)
        names = [F.col(d).alias(f"d{i}") for i, d in enumerate(kept)]
        shape = tuple(self.shape[int(d[1:])] for d in kept)
        return Tensor(df.select(*names, "v"), shape), Tensor(df.select(*names, F.col("at").alias("v")), shape)

    def argmax(self, axis: int | None = None) -> Tensor:
        return self.max_argmax(axis)[1]

    def argmin(self, axis: int | None = None) -> Tensor:
        return self.min_argmin(axis)[1]

    def argsort(self, axis: int = -1, descending: bool = False) -> Tensor:
        """Places in stable ascending order along an axis; descending is that order reversed."""
        d = f"d{self._axis(axis)}"
        kept = [x for x in self.dims if x != d]
        if not kept:  # one sequence: sorted in range partitions
            sorted_ = with_positions(self.df, ["v", d])
            place = F.lit(self.numel() - 1) - F.col("pos") if descending else F.col("pos")
            return Tensor(sorted_.select(place.alias("rank"), F.col(d).alias("v")).withColumnRenamed("rank", d), self.shape)
        order = [F.col("v").desc(), F.col(d).desc()] if descending else [F.col("v"), F.col(d)]
        rank = F.row_number().over(Window.partitionBy(*kept).orderBy(*order)) - 1
        return Tensor(self.df.select(*kept, rank.alias("rank"), F.col(d).alias("v")).withColumnRenamed("rank", d), self.shape)

    def softmax(self, axis: int | None = None) -> Tensor:
        """Along an axis, or over all cells. The maxima and sums are aggregated first, then joined."""
        kept, _ = self._by(axis)
        top = self.df.groupBy(*kept).agg(F.max("v").alias("top"))
        joined = (self.df.join(top, kept) if kept else self.df.join(F.broadcast(top))).withColumn("e", F.exp(F.col("v") - F.col("top")))  # without an axis, top is one row
        below = joined.groupBy(*kept).agg(F.sum("e").alias("below"))
        joined = joined.join(below, kept) if kept else joined.join(F.broadcast(below))
        return Tensor(joined.withColumn("v", F.col("e") / F.col("below")), self.shape)

    # two tensors

    def with_other(self, other: Tensor, fn: Callable[[Column, Column], Column]) -> Tensor:
        if self.shape != other.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape} differ")
        right = other.df.withColumnRenamed("v", "w")
        return Tensor(self.df.join(right, self.dims).withColumn("v", fn(F.col("v"), F.col("w"))), self.shape)

    def isclose(self, other: Tensor, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Tensor:
        return self.with_other(other, lambda a, b: _isclose(a, b, rtol, atol, equal_nan))

    def allclose(self, other: Tensor, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> bool:
        return bool(self.isclose(other, rtol, atol, equal_nan).df.agg(F.coalesce(F.bool_and("v"), F.lit(True))).first()[0])

    def array_equal(self, other: Tensor, equal_nan: bool = False) -> bool:
        if self.shape != other.shape:
            return False
        cell = lambda df, v: df.select(*self.dims, F.struct(F.col("v").alias("v")).alias(v))
        both = cell(self.df, "x").join(cell(other.df, "y"), self.dims, "full")  # a cell that one of them lacks makes them differ
        a, b = F.col("x")["v"], F.col("y")["v"]
        same = F.col("x").isNotNull() & F.col("y").isNotNull() & a.eqNullSafe(b) & (F.lit(equal_nan) | ~F.coalesce(F.isnan(a.cast("double")), F.lit(False)))
        return bool(both.agg(F.coalesce(F.bool_and(same), F.lit(True))).first()[0])

    def matmul(self, other: Tensor) -> Tensor:
        """(..., n, k) by (..., k, m), as a join on k and the axes before, and a sum. A vector is a row on the left, a column
        on the right; axes before the last two are equal, or one side has none."""
        if self.ndim == 1:
            out = self.atleast_nd(2, front=True).matmul(other)
            return out._without(out.ndim - (2 if other.ndim > 1 else 1))
        if other.ndim == 1:
            out = self.matmul(other.atleast_nd(2))
            return out._without(out.ndim - 1)
        more, others = self.shape[:-2], other.shape[:-2]
        if self.shape[-1] != other.shape[-2] or (more and others and more != others):
            raise ValueError(f"shapes {self.shape} and {other.shape} don't match")
        batch = more or others
        cells = lambda t, a, b, v: t.df.select(*[F.col(f"d{i}").alias(f"b{i}") for i in range(t.ndim - 2)], F.col(f"d{t.ndim - 2}").alias(a), F.col(f"d{t.ndim - 1}").alias(b), F.col("v").alias(v))
        shared = [f"b{i}" for i in range(len(batch))] if more and others else []
        joined = cells(self, "i", "k", "x").join(cells(other, "k", "j", "y"), [*shared, "k"])
        keys = [F.col(c).alias(f"d{n}") for n, c in enumerate([*[f"b{i}" for i in range(len(batch))], "i", "j"])]
        return Tensor(joined.groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("v")), (*batch, self.shape[-2], other.shape[-1]))

    def _without(self, axis: int) -> Tensor:
        """Without an axis of length 1."""
        left = [i for i in range(self.ndim) if i != axis]
        return Tensor(self.df.select(*[F.col(f"d{i}").alias(f"d{n}") for n, i in enumerate(left)], "v"), tuple(self.shape[i] for i in left))

    def kron(self, other: Tensor) -> Tensor:
        """Every cell times every cell of the other, which is the result's own size."""
        if self.ndim != other.ndim:
            raise ValueError("ranks differ")
        right = other.df.select(*[F.col(d).alias(f"o{i}") for i, d in enumerate(other.dims)], F.col("v").alias("w"))
        cells = self.df.crossJoin(right)
        cols = [(F.col(d) * n + F.col(f"o{i}")).alias(d) for i, (d, n) in enumerate(zip(self.dims, other.shape, strict=True))]
        return Tensor(cells.select(*cols, (F.col("v") * F.col("w")).alias("v")), tuple(a * b for a, b in zip(self.shape, other.shape, strict=True)))

    def nonzero(self) -> DataFrame:
        """The index columns of the cells that aren't zero."""
        return self.df.where(F.col("v") != 0).select(*self.dims)


def cat(tensors: list[Tensor], axis: int = -1) -> Tensor:
    first = tensors[0]
    axis = first._axis(axis)
    out, at = None, 0
    for t in tensors:
        if t.ndim != first.ndim or any(a != b for i, (a, b) in enumerate(zip(t.shape, first.shape, strict=True)) if i != axis):
            raise ValueError("shapes differ beside the axis")
        df = t.df.withColumn(f"d{axis}", F.col(f"d{axis}") + at)
        out, at = (df if out is None else out.unionByName(df)), at + t.shape[axis]
    return Tensor(out, tuple(at if i == axis else n for i, n in enumerate(first.shape)))


def hstack(tensors: list[Tensor]) -> Tensor:
    return cat(tensors, 0 if tensors[0].ndim == 1 else 1)


def vstack(tensors: list[Tensor]) -> Tensor:
    return cat([t.atleast_nd(2, front=True) for t in tensors], 0)


_KINDS = {"float16": ("float", "f", 16), "float32": ("float", "f", 32), "float64": ("double", "f", 64), "float": ("double", "f", 64), "int8": ("tinyint", "i", 8), "int16": ("smallint", "i", 16), "int32": ("int", "i", 32), "int64": ("bigint", "i", 64), "int": ("bigint", "i", 64), "uint8": ("smallint", "u", 8), "uint16": ("int", "u", 16), "uint32": ("bigint", "u", 32), "uint64": ("decimal(20,0)", "u", 64), "bool": ("boolean", "b", 8)}


def spark_type(name: str) -> str:
    """The Spark type that holds a numeric type: itself or the next wider one; of a complex one a struct of its parts."""
    if name.startswith("complex"):
        part = "float" if name == "complex64" else "double"
        return f"struct<re:{part},im:{part}>"
    return _KINDS[name][0]


def dtype_kind(kind: str) -> str:
    """f, i, u, c or b for a Spark type, O for others."""
    return {"float": "f", "double": "f", "tinyint": "i", "smallint": "i", "int": "i", "bigint": "i", "decimal(20,0)": "u", "struct<re:float,im:float>": "c", "struct<re:double,im:double>": "c", "boolean": "b"}.get(kind, "O")


def dtype_info(name: str) -> dict:
    """Bits, least and greatest value; of floats also the step at 1. Complex types have those of their parts."""
    if name.startswith("complex"):
        return dtype_info(f"float{int(name[7:]) // 2}") | {"dtype": name, "kind": "c", "bits": int(name[7:])}
    _, kind, bits = _KINDS[name]
    if kind == "f":
        info = np.finfo(f"float{bits}")
        return {"dtype": name, "kind": kind, "bits": bits, "min": float(info.min), "max": float(info.max), "eps": float(info.eps)}
    low = -(2 ** (bits - 1)) if kind == "i" else 0
    return {"dtype": name, "kind": kind, "bits": bits, "min": low, "max": 1 if kind == "b" else low + 2**bits - 1}


def result_type(*names: str) -> str:
    """The numeric type that holds all of the given ones."""
    return str(np.result_type(*[np.dtype(n) for n in names]))
