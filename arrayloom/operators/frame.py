"""A frame whose rows have positions: an immutable wrapper round a DataFrame with a position column.

The position column need not be gapless after a filter; `take` and `iloc` go by position values of the frame as it was
made. Every method returns a new frame; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.sources import frames as S  # noqa: N812

POS = S.POS


class Frame:
    def __init__(self, df: DataFrame) -> None:
        if POS not in df.columns:
            raise ValueError(f"no column {POS}")
        self.df = df.select(POS, *[c for c in df.columns if c != POS])

    @classmethod
    def make(cls, spark: SparkSession, data=None, columns: list[str] | None = None) -> Frame:
        """From nothing, a dict of columns, a matrix with column names, pandas, or another frame."""
        if isinstance(data, Frame):
            return cls(data.df)
        if isinstance(data, DataFrame):
            return cls(data)
        if isinstance(data, pd.DataFrame):
            return cls(S.from_pandas(spark, data))
        if isinstance(data, dict):
            return cls(S.from_columns(spark, data))
        if columns is not None and (data is None or isinstance(data, (list, tuple))):
            return cls(S.from_matrix(spark, data, columns))
        if data is None:
            return cls(S.from_columns(spark, {}))
        raise TypeError(type(data))

    from_pandas = classmethod(lambda cls, spark, pdf: cls(S.from_pandas(spark, pdf)))
    from_dict = classmethod(lambda cls, spark, records: cls(S.from_records(spark, records)))

    # looking

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != POS]

    keys = lambda self: self.columns

    def __contains__(self, key: str) -> bool:
        return key in self.columns

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self:
            raise KeyError(key)
        return self.df.select(POS, key)

    def get(self, key: str, default=None) -> DataFrame:
        return self.df.select(POS, F.col(key) if key in self else F.lit(default).alias(key))

    def getcols(self, keys: list[str]) -> DataFrame:
        """The columns as one array of doubles for each row; array columns are laid flat."""
        kinds = dict(self.df.dtypes)
        parts = [F.transform(k, lambda x: x.cast("double")) if kinds[k].startswith("array") else F.array(F.col(k).cast("double")) for k in keys]
        return self.df.select(POS, F.concat(*parts).alias("values"))

    @property
    def values(self) -> DataFrame:
        return self.getcols(self.columns)

    def iloc(self, at: int | slice) -> DataFrame:
        """Rows by position; of a slice without a start or stop, from the first or to the last. Negative ones count from the end."""
        bounds = [at.start, at.stop] if isinstance(at, slice) else [at]
        df, n = self.df, F.lit(0)
        if any(x is not None and x < 0 for x in bounds):
            df, n = self.df.join(F.broadcast(self._end())), F.col("_end")  # one row
        place = lambda x: F.greatest(n + x, F.lit(0)) if x < 0 else F.lit(x)
        if isinstance(at, slice):
            if (at.step or 1) < 1:
                raise ValueError("a step must be positive")
            start = F.lit(0) if at.start is None else place(at.start)
            high = F.lit(True) if at.stop is None else F.col(POS) < place(at.stop)
            return df.where((F.col(POS) >= start) & high & ((F.col(POS) - start) % (at.step or 1) == 0)).select(*self.df.columns)
        return df.where(F.col(POS) == (n + at if at < 0 else F.lit(at))).select(*self.df.columns)

    loc = iloc

    def _end(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.max(POS) + 1, F.lit(0)).alias("_end"))

    def iterrows(self) -> Iterator[tuple[int, dict]]:
        return S.iterrows(self.df)

    def pandas(self) -> pd.DataFrame:
        return S.to_pandas(self.df)

    def to_dict(self, orient: str = "dict") -> dict:
        return S.to_dict(self.df, orient)

    def to_string(self) -> str:
        return S.to_string(self.df)

    # making other frames

    def assign(self, key: str, value: Column | DataFrame) -> Frame:
        """A column from an expression, or from a frame of (pos, value)."""
        if isinstance(value, DataFrame):
            other = value.select(POS, F.col([c for c in value.columns if c != POS][0]).alias("_new"))
            return Frame(self.df.drop(key).join(other, POS, "left").withColumnRenamed("_new", key))
        return Frame(self.df.withColumn(key, value))

    def take(self, indices: list[int] | DataFrame) -> Frame:
        """Rows at the positions in the order given, repeats allowed; negative ones count from the end. Indices: a list, or a frame of (at, pos)."""
        literal = not isinstance(indices, DataFrame)
        if literal:
            negative = any(i < 0 for i in indices)
            indices = self.df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(indices)], "at bigint, pos bigint")
        else:
            negative = True
        if negative:
            indices = indices.join(F.broadcast(self._end())).select(F.when(F.col("at") < 0, F.col("at") + F.col("_end")).otherwise(F.col("at")).alias("at"), POS)  # one row
        return Frame(self.df.withColumnRenamed(POS, "at").join(F.broadcast(indices) if literal else indices, "at").drop("at"))

    def compress(self, flags: Column | list[bool]) -> Frame:
        """Rows whose flag is true: a predicate, or a literal mask by position."""
        if isinstance(flags, Column):
            return Frame(self.df.where(flags))
        kept = self.df.sparkSession.createDataFrame([(i,) for i, f in enumerate(flags) if f], f"{POS} bigint")
        return Frame(self.df.join(F.broadcast(kept), POS, "left_semi"))  # a literal list

    def sort_values(self, key: str, ascending: bool = True) -> Frame:
        """Positions anew in the order of a column, ties by old position; descending is that order reversed."""
        if ascending:
            return Frame(S.with_positions(self.df.withColumnRenamed(POS, "_was"), [key, "_was"]).drop("_was"))
        flipped = S.with_positions(self.df.withColumnRenamed(POS, "_was"), [key, "_was"]).drop("_was")
        n = flipped.agg(F.count("*").alias("_n"))
        return Frame(flipped.join(F.broadcast(n)).withColumn(POS, F.col("_n") - 1 - F.col(POS)).drop("_n"))  # one row

    def copy(self) -> Frame:
        return Frame(self.df)

    def clear(self) -> Frame:
        return Frame(self.df.limit(0))

    def extend(self, other: Frame) -> Frame:
        """Rows of another frame after these, by name; its further columns are dropped, a missing one raises KeyError."""
        missing = set(self.columns) - set(other.columns)
        if missing:
            raise KeyError(sorted(missing))
        moved = other.df.join(F.broadcast(self._end())).withColumn(POS, F.col(POS) + F.col("_end"))  # one row
        return Frame(self.df.unionByName(moved.select(POS, *self.columns)))

    def union(self, *others: Frame) -> Frame:
        """Rows of all frames, repeats kept."""
        return reduce(lambda a, b: b if not a.columns else a.extend(b), others, self)

    @staticmethod
    def concat(frames: list[Frame]) -> Frame:
        return frames[0].union(*frames[1:])

    def groupby(self, by: str) -> DataFrame:
        """A row for each key with its rows in order, as an array of structs; aggregate with df.groupBy where a value will do."""
        return self.df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*self.df.columns))).alias("rows"))

    def rename(self, mapper: dict[str, str] | None = None, columns: dict[str, str] | None = None, axis: int | None = None) -> Frame:
        """Columns by other names, in their places; unknown ones are ignored."""
        if columns is None and axis != 1:
            raise ValueError("give columns, or axis=1")
        return Frame(self.df.withColumnsRenamed({k: v for k, v in (columns or mapper or {}).items() if k in self}))

    def reset_index(self, drop: bool = True) -> Frame:
        return Frame(self.df)

    def equals(self, other: Frame) -> DataFrame:
        """pos, then whether each column is equal there; NaN equals NaN."""
        right = other.df.select(POS, *[F.col(c).alias(f"_{c}") for c in self.columns])
        return self.df.join(right, POS, "full").select(POS, *[F.col(c).eqNullSafe(F.col(f"_{c}")).alias(c) for c in self.columns])

    def same_rows(self, other: Frame) -> bool:
        a, b = self.df.select(*self.columns), other.df.select(*self.columns)
        return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0
