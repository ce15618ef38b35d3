"""Slices that may reach beyond the data, as column arithmetic, and padding of positioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.elementwise import source_place


def coerce_pad(pad, dims: int) -> list[tuple[int, int]]:
    """None, a number, or a list of numbers or pairs, as a pair for each axis."""
    if pad is None:
        return [(0, 0)] * dims
    if isinstance(pad, int):
        return [(pad, pad)] * dims
    if len(pad) != dims:
        raise ValueError(f"{len(pad)} pads for {dims} axes")
    return [(p, p) if isinstance(p, int) else tuple(p) for p in pad]


def embed_slice(slices: list[tuple[int | None, int | None]], shape: list[int], pad=None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The part of each slice that lies in the data, and how much is missing before and after it."""
    if len(slices) != len(shape):
        raise ValueError(f"{len(slices)} slices for {len(shape)} axes")
    inside, extra = [], []
    for (low, high), n, (before, after) in zip(slices, shape, coerce_pad(pad, len(shape)), strict=True):
        low, high = (0 if low is None else low) - before, (n if high is None else high) + after
        if low > high:
            raise ValueError(f"slice {low}:{high} ends before it starts")
        start, stop = min(max(low, 0), n), max(min(high, n), 0)
        inside.append((start, max(stop, start)))
        extra.append((max(0, min(high, 0) - low), max(0, high - max(low, n))))
    return inside, extra


def embed_columns(low: Column, high: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    """embed_slice for columns: start, stop, missing before, missing after."""
    zero = F.lit(0)
    start = F.least(F.greatest(low, zero), n)
    stop = F.greatest(F.greatest(F.least(high, n), zero), start)
    return start, stop, F.greatest(zero, F.least(high, zero) - low), F.greatest(zero, high - F.greatest(low, n))


#: Modes that fill with one number made of the slice.
SUMMARIES = {"mean": F.avg, "maximum": F.max, "minimum": F.min, "median": F.median}


def padded_slice(df: DataFrame, pos: str, value: str, start: int, stop: int, pad: tuple[int, int] = (0, 0), by: list[str] | None = None, fill=0, mode: str = "constant", size: str | None = None) -> DataFrame:
    """Rows start - pad to stop + pad of each `by` group, numbered from 0 in `pos`; what lies outside is filled.

    mode: constant (with `fill`), one of source_place, or one of SUMMARIES, of the part of the slice that lies in the
    group; all but constant need `size`, a column with the group's length. Where no part does, `fill` stands.
    """
    if mode != "constant" and size is None:
        raise ValueError(f"mode {mode} needs the groups' sizes")
    low, high = start - pad[0], stop + pad[1]
    if low > high:
        raise ValueError("the slice ends before it starts")
    by = by or []
    if low == high:
        return df.select(*by, pos, value).limit(0)
    if by or size:
        groups = df.select(*by, *([size] if size else [])).distinct()
        grid = groups.withColumn("_at", F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint"))))
    else:
        grid = df.sparkSession.range(low, high).withColumnRenamed("id", "_at")
    cells = df.select(*by, pos, value)
    if mode == "constant":
        source = F.col("_at")
    elif mode in SUMMARIES:
        source, inner = F.col("_at"), cells.where((F.col(pos) >= low) & (F.col(pos) < high))
        made = inner.groupBy(*by).agg(SUMMARIES[mode](value).alias("_fill"))
        grid = grid.join(made, by, "left") if by else grid.join(F.broadcast(made))  # without groups, one row
    else:
        n = F.col(size)
        first, last = F.least(F.greatest(F.lit(low), F.lit(0)), n), F.least(F.greatest(F.lit(high), F.lit(0)), n)
        source = F.when(last > first, first + source_place(F.col("_at") - first, last - first, mode))
    grid = grid.withColumn(pos, source.cast("bigint"))
    out = grid.join(cells, [*by, pos], "left")
    if mode in SUMMARIES:
        out = out.withColumn(value, F.coalesce(F.col(value).cast("double"), "_fill"))
    return out.select(*by, (F.col("_at") - low).alias(pos), F.coalesce(F.col(value), F.lit(fill)).alias(value))


def apply_embedded_slice(df: DataFrame, pos: str, value: str, inside: tuple[int, int], extra: tuple[int, int], by: list[str] | None = None, fill=0) -> DataFrame:
    """padded_slice by what embed_slice returned for an axis."""
    return padded_slice(df, pos, value, inside[0] - extra[0], inside[1] + extra[1], by=by, fill=fill)


def apply_padding(df: DataFrame, pos: str, value: str, n: int, pad: tuple[int, int], by: list[str] | None = None, fill=0) -> DataFrame:
    return padded_slice(df, pos, value, 0, n, pad, by, fill)
