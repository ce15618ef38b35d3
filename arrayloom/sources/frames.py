"""Frames from and to what lives on the driver, and positions for rows that have none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrayloom.sources.store import settled

POS = "pos"


def from_columns(spark: SparkSession, data: dict[str, list], schema: str | None = None) -> DataFrame:
    """Columns of equal length, with a position first."""
    lengths = {len(v) for v in data.values()}
    if len(lengths) > 1:
        raise ValueError(f"columns have lengths {sorted(lengths)}")
    rows = [(i, *row) for i, row in enumerate(zip(*(list(v) for v in data.values()), strict=True))]
    if schema is None and not rows:
        return spark.createDataFrame([], T.StructType([T.StructField(POS, T.LongType())] + [T.StructField(c, T.StringType()) for c in data]))
    return spark.createDataFrame(rows, f"{POS} bigint, {schema}" if schema else [POS, *data])


def from_records(spark: SparkSession, records: list[dict], schema: str | None = None) -> DataFrame:
    """Rows as dicts; the first fixes the columns, another one's extra or missing key raises KeyError."""
    columns = list(records[0]) if records else []
    for r in records:
        if set(r) != set(columns):
            raise KeyError(sorted(set(r) ^ set(columns)))
    return from_columns(spark, {c: [r[c] for r in records] for c in columns}, schema)


def from_matrix(spark: SparkSession, data: list[list] | None, columns: list[str]) -> DataFrame:
    """Rows of a matrix under the given column names; without data, no rows."""
    return from_columns(spark, {c: [row[i] for row in data or []] for i, c in enumerate(columns)})


def from_pandas(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(pdf.reset_index(drop=True).rename_axis(POS).reset_index())


def read(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """A Parquet table with positions in the given order."""
    return with_positions(spark.read.parquet(path), order)


def with_positions(df: DataFrame, order: list[str], pos: str = POS) -> DataFrame:
    """df with positions 0 to n - 1 in the given order; ties are broken by all columns.

    Rows are sorted in range partitions, numbered within each, and moved by the sizes of the partitions before; only
    those sizes meet in one place. The sorted rows are settled, since bounds of ranges are sampled: computed twice, they
    could differ.
    """
    placed = _placed(df, order).withColumn("_in", F.col("_id").bitwiseAND(F.lit(2**33 - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn(pos, F.col("_before") + F.col("_in")).select(pos, *df.columns)


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df in range partitions, sorted within each, settled, with _id and _part."""
    keys = [*order, *(c for c in df.columns if c not in order)]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return settled(placed).withColumn("_part", F.shiftright("_id", 33))


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of a column up to each row in the given order: sums within range partitions, moved by those of the partitions before."""
    placed = _placed(df, order)
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = placed.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    summed = placed.withColumn("_in", F.sum(value).over(inside))
    return summed.join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col("_in")).alias(out))


def to_pandas(df: DataFrame, pos: str = POS) -> pd.DataFrame:
    return df.orderBy(pos).drop(pos).toPandas()


def to_dict(df: DataFrame, orient: str = "dict", pos: str = POS) -> dict:
    """dict: rows by number; list: columns; other orients as pandas has them."""
    if orient == "dict":
        return {i: r for i, (_, r) in enumerate(iterrows(df, pos))}
    if orient == "list":
        return {c: v.tolist() for c, v in to_pandas(df, pos).items()}
    return to_pandas(df, pos).to_dict(orient)


def to_string(df: DataFrame, pos: str = POS) -> str:
    return to_pandas(df, pos).to_string()


def iterrows(df: DataFrame, pos: str = POS) -> Iterator[tuple[int, dict]]:
    """(position, row) in order, fetched partition by partition."""
    for r in df.orderBy(pos).toLocalIterator():
        row = r.asDict()
        yield row.pop(pos), row
