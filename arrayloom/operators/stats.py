"""Descriptive, running and pooled statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.elementwise import NAN, divide


def stats(df: DataFrame, value: str, by: list[str] | None = None, *, nan: bool = False, sum: bool = False, extreme: bool = True, n_extreme: bool = False, median: bool = False, size: bool = False, shape: bool = False, quantile: str | bool | list[float] | None = "auto") -> DataFrame:  # noqa: A002
    """Mean, population std, extremes and quantiles (linear) of each `by` group.

    nan: NaN is left out of mean, std, sum and extremes, and counted as num_nan. med always leaves NaN out; other
    quantiles never do. n_extreme: how often the extremes occur. shape: the number of values as an array, as one axis has it. Everything comes from one aggregation; the counts of
    extremes from a count by value above it.
    """
    by = by or []
    quantiles = [0.25, 0.5, 0.75] if quantile in ("auto", True) else (quantile or [])
    x = F.col(value).cast("double")
    used = F.when(~F.isnan(x), x) if nan else x
    least = F.min(used) if nan else F.when(F.bool_or(F.isnan(x)), NAN).otherwise(F.min(x))
    cols = [F.avg(used).alias("mean"), F.stddev_pop(used).alias("std")]
    if extreme:
        cols += [least.alias("min"), F.max(used).alias("max")]
    if quantiles:
        cols.append(F.percentile(x, F.array(*[F.lit(float(q)) for q in quantiles])).alias("_q"))
    if median:
        cols.append(F.median(F.when(~F.isnan(x), x)).alias("med"))
    if nan:
        cols.append(F.count_if(F.isnan(x)).alias("num_nan"))
    if sum:
        cols.append(F.sum(used).alias("sum"))
    if size:
        cols.append(F.count("*").alias("size"))
    if shape:
        cols.append(F.array(F.count("*")).alias("shape"))
    out = df.groupBy(*by).agg(*cols)
    for i, q in enumerate(quantiles):
        out = out.withColumn(f"q_{q:.2f}".replace(".", "_"), F.col("_q")[i])
    out = out.drop("_q")
    if n_extreme:
        counts = df.select(*by, x.alias("_x")).where(~F.isnan("_x") if nan else F.lit(True)).groupBy(*by, "_x").agg(F.count("*").alias("_n"))
        ends = counts.groupBy(*by).agg(F.min_by("_n", "_x").alias("nMin"), F.max_by("_n", "_x").alias("nMax"))
        out = out.join(ends, by) if by else out.join(F.broadcast(ends))  # without groups, one row
    return out




def running(df: DataFrame, value: str, weight: Column | str | None = None, by: list[str] | None = None, nan_policy: str = "omit") -> DataFrame:
    """Accumulators total, squares, max, min and n of each `by` group; they merge by `merged`.

    total sums w * x, squares sums (w * x) ** 2, n sums w; cells of weight 0 don't count for the extremes. omit: NaN has
    weight 0. propagate: NaN stays. raise: NaN is an error.
    """
    if nan_policy not in ("omit", "propagate", "propogate", "raise"):
        raise KeyError(nan_policy)
    x = F.col(value).cast("double")
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    if nan_policy == "omit":
        w, x = F.when(F.isnan(x), 0.0).otherwise(w), F.nanvl(x, F.lit(0.0))
    elif nan_policy == "raise":
        x = F.when(F.isnan(x), F.raise_error(F.lit("NaN in running statistics")).cast("double")).otherwise(x)
    used = F.when(w != 0, x)
    return df.groupBy(*(by or [])).agg(F.sum(w * x).alias("total"), F.sum(F.pow(w * x, F.lit(2.0))).alias("squares"), F.max(used).alias("max"), F.min(used).alias("min"), F.sum(w).alias("n"))


def merged(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accumulators of coarser groups from those of finer ones."""
    return states.groupBy(*(by or [])).agg(F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("max").alias("max"), F.min("min").alias("min"), F.sum("n").alias("n"))


def sumsq_std(total: Column, squares: Column, n: Column) -> Column:
    """Sample std from sums: sqrt((n * squares - total ** 2) / (n * (n - 1))); NaN for n of 1."""
    above, below = n * squares - total * total, n * (n - 1)
    return F.when(below == 0, NAN).otherwise(F.sqrt(F.greatest(F.lit(0.0), divide(above, below))))


def summary(states: DataFrame) -> DataFrame:
    """mean and std beside the accumulators; groups whose weights are 0 have NaN. Accumulators that never saw a row raise an error."""
    unseen = F.raise_error(F.lit("no data have been added to the accumulators")).cast("double")
    mean = F.when(F.col("n").isNull(), unseen).otherwise(divide(F.col("total"), F.col("n")))
    return states.withColumn("mean", mean).withColumn("std", sumsq_std(F.col("total"), F.col("squares"), F.col("n")))


def combine_mean_stds(df: DataFrame, mean: str, std: str, n: str | None, by: list[str] | None = None, bessel: int = 1, variance: bool = False) -> DataFrame:
    """Pooled mean and std of groups given by mean, std and size.

    Without sizes, the limit of equal large ones. Within groups the std itself is pooled; variance: its square is. Sizes
    below the correction count as 0 there.
    """
    by = by or []
    m, s = F.col(mean).cast("double"), F.col(std).cast("double")
    within = s * s if variance else s
    if n is None:
        k = df.groupBy(*by).agg(F.avg(m).alias("_m"), F.count("*").alias("_k"))
        joined = df.join(k, by) if by else df.join(F.broadcast(k))  # one row
        return joined.groupBy(*by).agg(F.first("_m").alias("mean"), F.sqrt(F.sum(within + F.pow(m - F.col("_m"), F.lit(2.0))) / F.first("_k")).alias("std"))
    size = F.col(n).cast("double")
    sums = df.groupBy(*by).agg(F.sum(size * m).alias("_s"), F.sum(size).alias("_n")).withColumn("_m", divide(F.col("_s"), F.col("_n")))
    joined = df.join(sums.drop("_s"), by) if by else df.join(F.broadcast(sums.drop("_s")))  # one row
    parts = joined.groupBy(*by).agg(F.first("_m").alias("mean"), F.first("_n").alias("_n"), F.sum(F.greatest(size - bessel, F.lit(0.0)) * within).alias("_in"), F.sum(size * F.pow(m - F.col("_m"), F.lit(2.0))).alias("_between"))
    std = F.sqrt(divide(F.col("_in") + F.col("_between"), F.greatest(F.col("_n") - bessel, F.lit(0.0))))
    return parts.select(*by, "mean", std.alias("std"))


def gmean(value: Column | str) -> Column:
    """An aggregate: exp(mean(log x)), 0 if a value is 0, NaN if one is negative."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(F.bool_or(F.isnan(x) | (x < 0)), NAN).when(F.bool_or(x == 0), F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(x > 0, x)))))


__all__ = ["combine_mean_stds", "gmean", "merged", "running", "stats", "summary", "sumsq_std"]
