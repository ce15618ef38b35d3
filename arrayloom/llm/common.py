"""What the operators of this package share: staged tables, size-checked broadcasts, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many (narrow) rows; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: An Arrow batch holds so many bytes and a row at most, just below what slices() cuts it into; Spark's default is 64 MB, which an
#: executor holds several times for each task: as a vector that grew by doubling, as the worker's batch, and as what is made of it.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset a folder of this machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="arrayloom")
        shared_dir.local = at
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arrayloom/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.block.size.row.check.min", 4)  # row groups that many tasks can read
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of frames that are gone."""
    gc.collect()
    spark._jvm.System.gc()


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on, its session hands rows to workers in batches of BATCH_BYTES, unless the session has a limit of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles. Left alone, Spark broadcasts a side by the size of the files below it, which are packed and compressed."""
    return df.hint("merge")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df for a join that shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a string column of about so many bytes each; a longer text is a range of its own."""
    _, offsets = text_buffer(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b
    trimmed()


def trimmed() -> None:
    """Give memory that is free back to the system; a worker process otherwise keeps the most it ever had for the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
