"""One name for an array operation, whatever form the array has: a tensor frame, or an array column within rows."""

from __future__ import annotations

from types import ModuleType

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions import rows
from arrayloom.operators.tensor import Tensor

#: What a tensor calls otherwise than an array column.
_TENSOR_NAMES = {"total": "sum", "maximum": "max", "minimum": "min", "any_true": "any", "all_true": "all"}


def impl(array: Tensor | Column | str) -> type[Tensor] | ModuleType:
    """What has the operations of an array: Tensor, or the functions of array columns."""
    if isinstance(array, Tensor):
        return Tensor
    if isinstance(array, (Column, str)):
        return rows
    raise TypeError(f"no array: {type(array).__name__}")


def coerce(spark: SparkSession, data, like: Tensor | Column | str | None = None) -> Tensor | Column:
    """Numbers of the driver in the form of `like`: a literal array column, or (by default) a tensor. What has a form keeps it."""
    if isinstance(data, (Tensor, Column)):
        return data
    if like is not None and impl(like) is rows:
        return F.array(*[F.lit(x) for x in np.asarray(data).tolist()])
    return Tensor.from_numpy(spark, data)


def call(name: str, array: Tensor | Column | str, *args, **kw):
    """The operation of that name (as array columns have it) on an array of either form."""
    home = impl(array)
    found = getattr(home, _TENSOR_NAMES.get(name, name) if home is Tensor else name, None)
    if found is None:
        raise AttributeError(f"{name} isn't an operation of {home.__name__}")
    return found(array, *args, **kw)
