"""Grouping, consecutive runs, and jagged lists. Positions are explicit columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.sources.frames import running_sum, with_positions


def group_items(df: DataFrame, key: str, item: str, pos: str) -> DataFrame:
    """key, items: the items of each key in order of position. NaN keys are one group."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(item).alias("x"))))
    return df.groupBy(key).agg(F.transform(listed, lambda s: s["x"]).alias("items"))


def group_indices(df: DataFrame, key: str, pos: str) -> DataFrame:
    """key, indices: the positions of each key, ascending."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(pos)).alias("indices"))


def apply_grouping(df: DataFrame, item: str, pos: str, groups: DataFrame, gid: str, indices: str) -> DataFrame:
    """gid, items: the items at each group's positions, in the order of its list."""
    wanted = groups.select(gid, F.posexplode(indices).alias("ord", pos))
    found = wanted.join(df.select(pos, item), pos)
    listed = F.array_sort(F.collect_list(F.struct("ord", F.col(item).alias("x"))))
    return found.groupBy(gid).agg(F.transform(listed, lambda s: s["x"]).alias("items"))


def island(value: Column | str, order: list[Column | str], by: list[Column | str], offset: int = 1) -> tuple[Column, Column]:
    """Two steps to number runs in which each value is the one before plus offset (0: runs of equal values):
    a flag of where a run begins, and the running count of a flag column named starts."""
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(value).over(w)
    starts = F.when(before.isNull(), 1).when(value - before != offset, 1).otherwise(0) if offset else F.when(before.eqNullSafe(value), 0).otherwise(1)
    return starts, F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))


def group_consecutive(df: DataFrame, value: str, pos: str, by: list[str] | None = None, offset: int = 1) -> DataFrame:
    """df with a column island: the number of the run of each row among those of its `by` group, or of all rows.

    Without groups rows are placed in range partitions, and a row meets the one before it in a join.
    """
    if not by:
        placed = with_positions(df, [pos], "_at")
        before = placed.select((F.col("_at") + 1).alias("_at"), F.struct(F.col(value).alias("v")).alias("_was"))
        joined = placed.join(before, "_at", "left")
        was, now = F.col("_was")["v"], F.col(value)
        starts = F.when(was.isNull(), 1).when(now - was != offset, 1).otherwise(0) if offset else F.when(F.col("_was").isNotNull() & was.eqNullSafe(now), 0).otherwise(1)
        return running_sum(joined.withColumn("starts", starts), ["_at"], "starts", "island").select(*df.columns, "island")
    starts, number = island(value, [pos], by, offset)
    return df.withColumn("starts", starts).withColumn("island", number).drop("starts")


def group_consecutive_indices(df: DataFrame, value: str, pos: str, by: list[str] | None = None, offset: int = 1) -> DataFrame:
    """Each run's first and last position and length."""
    runs = group_consecutive(df, value, pos, by, offset)
    return runs.groupBy(*(by or []), "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"))


def flat_bounds(lengths: DataFrame, outer: str, length: str, by: list[str] | None = None) -> DataFrame:
    """lengths with start and stop, the flat range of each outer list; one sequence for each `by` group, or one of all."""
    if not by:
        return running_sum(lengths, [outer], length, "stop").withColumn("start", F.col("stop") - F.col(length))
    w = Window.partitionBy(*by).orderBy(outer)
    stop = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lengths.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col(length))


def flat_ravel(at: DataFrame, bounds: DataFrame, outer: str, inner: str) -> DataFrame:
    """at with flat, the place of (outer, inner)."""
    return at.join(bounds.select(outer, "start"), outer).withColumn("flat", F.col("start") + F.col(inner)).drop("start")


def flat_lengths(lists: DataFrame, outer: str, items: str) -> DataFrame:
    """outer, n: the length of each list of an array column, for flat_bounds; null has none."""
    return lists.select(outer, F.when(F.col(items).isNull(), 0).otherwise(F.size(items)).cast("bigint").alias("n"))


def flat_length(bounds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n: how many flat places there are, in all or in each `by` group."""
    return bounds.groupBy(*(by or [])).agg(F.coalesce(F.max("stop"), F.lit(0)).alias("n"))


def flat_unravel(at: DataFrame, bounds: DataFrame, outer: str, flat: str, bucket: int = 1024, by: list[str] | None = None) -> DataFrame:
    """at with outer and inner of a flat place, in its `by` group; places outside all lists are dropped.

    A range join by buckets of flat places: each list goes to the buckets that it meets, so the join is on equal buckets.
    """
    ranges = bounds.where("stop > start").select(*(by or []), F.col(outer).alias("outer"), "start", "stop")
    first, last = F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket)
    ranges = ranges.withColumn("bucket", F.explode(F.sequence(first, last)))
    keyed = at.withColumn("bucket", F.floor(F.col(flat) / bucket))
    met = keyed.join(ranges, [*(by or []), "bucket"]).where((F.col("start") <= F.col(flat)) & (F.col(flat) < F.col("stop")))
    return met.withColumn("inner", F.col(flat) - F.col("start")).drop("bucket", "start", "stop")
