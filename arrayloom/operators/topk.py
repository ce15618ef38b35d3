"""Top-k, lexicographic maxima, distinct rows, masks. Ties go to the smaller position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.operators.tensor import Tensor


def _top(df: DataFrame, value: str, pos: list[str], k: int, by: list[str], down: bool) -> DataFrame:
    if k < 0:
        raise IndexError("k is negative")
    order = [F.col(value).desc() if down else F.col(value).asc(), *pos]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def argmaxima(df: DataFrame, value: str, pos: list[str], k: int, by: list[str] | None = None) -> DataFrame:
    """The k rows of largest value, of all (a top-k without a full sort) or of each `by` group (with their rank)."""
    return _top(df, value, pos, k, by or [], True)


def argminima(df: DataFrame, value: str, pos: list[str], k: int, by: list[str] | None = None) -> DataFrame:
    return _top(df, value, pos, k, by or [], False)


def arglexmax(df: DataFrame, keys: list[str], pos: str, multi: bool = False) -> DataFrame:
    """The position of the largest row by the last key, then the one before it, and so on. multi: of all equal ones."""
    key = F.struct(*[F.col(k) for k in reversed(keys)])
    if not multi:
        return df.agg(F.max(F.struct(key.alias("key"), (-F.col(pos)).alias("p"))).alias("best")).select((-F.col("best.p")).alias(pos))
    best = df.agg(F.max(key).alias("best"))
    return df.join(F.broadcast(best), key == F.col("best")).select(pos)  # one row


def unique_rows(df: DataFrame, columns: list[str], pos: str | None = None) -> DataFrame:
    """Distinct rows; with a position, also the first of each as `pos`."""
    return df.select(*columns).distinct() if pos is None else df.groupBy(*columns).agg(F.min(pos).alias(pos))


def boolmask(indices: DataFrame, index: str | list[str], n: int | tuple[int, ...]) -> DataFrame:
    """pos, flag for 0 to n - 1: whether pos is among the indices; for a list of columns and a shape, d0, d1, ..., flag."""
    if not isinstance(index, str):
        dims = [f"d{i}" for i in range(len(index))]
        marked = indices.select(*[F.col(c).cast("bigint").alias(d) for c, d in zip(index, dims, strict=True)]).distinct().withColumn("flag", F.lit(True))
        grid = Tensor.full(indices.sparkSession, tuple(n), 0).df.select(*dims)
        return grid.join(marked, dims, "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    marked = indices.select(F.col(index).cast("bigint").alias("pos")).distinct().withColumn("flag", F.lit(True))
    return indices.sparkSession.range(n).withColumnRenamed("id", "pos").join(marked, "pos", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def isect_rows(df: DataFrame, column: str, other: DataFrame, other_column: str, out: str = "flag") -> DataFrame:
    """df with a flag: whether the value occurs in a column of another frame."""
    known = other.select(F.col(other_column).alias("_known")).distinct().withColumn("_hit", F.lit(True))
    return df.join(known, df[column] == F.col("_known"), "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_known", "_hit")
