"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, then exact distances of what survives.

Vectors are scaled to length 1 and rounded to int8 with a scale of their own. The product of an int8 query block and an
int8 candidate block gives all cosines of a tile to within a known error: with a = u + e and b = v + f (u, v the rounded
vectors), |a.b - u.v| <= |e| |v| + |f| |a|. Products are taken over SLICE dimensions at a time, whose sums are whole
numbers below 2^24 and so exact in single precision, and added up in double precision: the bound holds in any dimension.
In a tile, a query's k-th highest lower bound is a threshold; candidates whose upper bound is below it can't be among its
k nearest. What survives its tile is merged by heaps: the k-th highest lower bound over all tiles is the next threshold.
Only what is left then meets the original vectors, in double precision, and a heap keeps the best k.

Queries and candidates are packed into blocks of rows; each pair of blocks is one tile, so no row is ever joined with a
row. Only int8 blocks are copied (a byte per component, once for each block of QUERY_ROWS queries), original vectors are
joined with survivors alone. Tiles of a block are spread over all tasks. Of equal vectors only the 2 k with the smallest
ids are compared: they tie, and ties go to the smaller id.

Defined cases: a vector that is null, zero, or has a null or non-finite component, or another length than most, takes no
part; a null id takes no part; ties go to the smaller id; equal vectors have equal scores; a query isn't its own
neighbour, rows of equal ids neither; of query rows with one id the one with the least bytes asks; fewer candidates than k
are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import binaries, dropped, staged

QUERY_ROWS, CANDIDATE_ROWS, SLICE = 8192, 32768, 1024


def usable(column: pa.Array, ids: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (rows of doubles) of the rows that take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    good = ids.is_valid().to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False) & (n == dim)
    picked = column.filter(pa.array(good))
    flat = picked.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ids = ids.filter(pa.array(good)).to_numpy().astype(np.int64)
    fine = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return ids[fine], flat[fine]


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors of unit length, their scales, and bounds of the rounding error's length."""
    big = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / big
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - whole * scale[:, None]) ** 2).sum(axis=1)) + 1e-9
    return whole.astype(np.int8), scale, error


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision; equal pairs of vectors have equal results."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of int8 rows, exact."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLICE):
        out += a[:, at : at + SLICE].astype(np.float32) @ b[:, at : at + SLICE].astype(np.float32).T  # below 2^24
    return out


class Coded:
    """A block of vectors: ids, places, int8 components, scales and error bounds."""

    names = ("ids", "places", "codes", "scales", "errors")
    types = (np.int64, np.int64, np.int8, np.float64, np.float64)

    def __init__(self, *data: bytes) -> None:
        self.ids, self.places, codes, self.scales, self.errors = (np.frombuffer(x, t) for x, t in zip(data, self.types, strict=True))
        self.codes = codes.reshape(len(self.ids), -1)

    @staticmethod
    def packed(ids: np.ndarray, places: np.ndarray, vectors: np.ndarray) -> list[bytes]:
        return [x.tobytes() for x in (ids, places, *rounded(vectors))]


def survivors(q: Coded, c: Coded, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query's place in its block, candidate's in its own, lower and upper bound) of what may be among a query's k nearest of a tile."""
    for a in range(0, len(q.ids), 128):
        some = slice(a, a + 128)
        near = products(q.codes[some], c.codes)
        near *= q.scales[some, None] * c.scales[None, :]
        slack = q.errors[some, None] * (1 + c.errors[None, :]) + c.errors[None, :]
        other = q.ids[some, None] != c.ids[None, :]
        low = np.where(other, near - slack, -np.inf)
        least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero(other & (near + slack >= least[:, None]))
        yield i + a, j, low[i, j], (near + slack)[i, j]


VECTORS = "id long, data binary"


def _usable_rows(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = usable(batch.column(1), batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), binaries([x.tobytes() for x in v])], names=["id", "data"])

    return run


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks (Coded) of at most `rows` vectors (id, place, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(x).to_pylist() for x in ("id", "place", "data")), strict=True)
            while len(held) >= rows:
                yield made(held[:rows])
                held = held[rows:]
        if held:
            yield made(held)

    def made(part: list[tuple]) -> pa.RecordBatch:
        ids, places, data = zip(*part, strict=True)
        packed = Coded.packed(np.array(ids, np.int64), np.array(places, np.int64), np.frombuffer(b"".join(data), np.float64).reshape(len(ids), -1))
        return pa.RecordBatch.from_arrays([binaries([x]) for x in packed], names=list(Coded.names))

    return vectors.mapInArrow(run, ", ".join(f"{x} binary" for x in Coded.names)).withColumn("block", F.monotonically_increasing_id())


def _by_query(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each query, of batches in order of query."""
    query, held = None, []
    for batch in batches:
        for q, *row in zip(*(batch.column(x).to_pylist() for x in ("query", *columns)), strict=True):
            if q != query:
                if held:
                    yield query, held
                query, held = q, []
            held.append(tuple(row))
    if held:
        yield query, held


def _merged(k: int):
    """Of each query's survivors, those that the k-th highest lower bound of all leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, rows in _by_query(batches, ("place", "low", "high")):
            least = heapq.nlargest(k, (low for _, low, _ in rows))[-1] if len(rows) > k else -np.inf
            left = [place for place, _, high in rows if high >= least]
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(left), pa.int64()), pa.array(left, pa.int64())], names=["query", "place"])

    return run


def _nearest(k: int):
    """query_id, rank, vec_id, score of the k best of each query's rows (q, id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, rows in _by_query(batches, ("asked", "id", "data")):
            double = lambda x: np.frombuffer(b"".join(x), np.float64).reshape(len(rows), -1)
            score = cosines(double([r[0] for r in rows]), double([r[2] for r in rows]))
            best = heapq.nsmallest(k, zip((-score).tolist(), (r[1] for r in rows), strict=True))
            n = len(best)
            yield pa.RecordBatch.from_arrays([pa.array([query] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([i for _, i in best], pa.int64()), pa.array([-s for s, _ in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    return run


def _typical(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (id, data) with equal vectors, the 2 k of smallest id, of one id k at most: no query can have others among its k nearest."""
    for key, most in ((["data", "id"], k), (["data"], 2 * k)):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("place") <= most).drop("place")
    return rows


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest cosine for each query."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shape = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    sizes = shape(vectors).where("v is not null").groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return empty
    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = _typical(shape(vectors).mapInArrow(_usable_rows(sizes.n), VECTORS), k)
    given, _ = staged(given.withColumn("place", F.monotonically_increasing_id()), "vectors")
    asked = shape(queries).mapInArrow(_usable_rows(sizes.n), VECTORS).groupBy("id").agg(F.min("data").alias("data"))
    asked, _ = staged(asked.withColumn("place", F.lit(0).cast("long")), "queries")
    q_blocks, q_at = staged(_blocks(asked, QUERY_ROWS), "query_blocks")
    c_blocks, c_at = staged(_blocks(given, CANDIDATE_ROWS), "candidate_blocks")
    numbers = q_blocks.select("block", F.row_number().over(Window.orderBy("block")).alias("no"))  # a row per block of queries
    n = numbers.count()
    if not n:
        return empty
    named = lambda df, side: [F.col(x).alias(f"{side}_{x}") for x in Coded.names]
    left = q_blocks.join(numbers, "block").select("no", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("share"), *named(q_blocks, "q"))
    right = c_blocks.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("no"), F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("share"), *named(c_blocks, "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(f"{side}_{x}").to_pylist() for side in "qc" for x in Coded.names), strict=True):
                q, c = Coded(*row[:5]), Coded(*row[5:])
                for i, j, low, high in survivors(q, c, k):
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(c.places[j]), pa.array(low), pa.array(high)], names=["query", "place", "low", "high"])

    tiles = left.join(right, ["no", "share"]).select(*(f"{side}_{x}" for side in "qc" for x in Coded.names))
    ordered = lambda df: df.repartition("query").sortWithinPartitions("query")
    found = ordered(tiles.mapInArrow(run, "query long, place long, low double, high double")).mapInArrow(_merged(k), "query long, place long")
    found, _ = staged(found, "survivors")
    dropped(spark, q_at)
    dropped(spark, c_at)
    pairs = found.join(given.select("place", "id", "data"), "place").join(asked.select(F.col("id").alias("query"), F.col("data").alias("asked")), "query")
    return ordered(pairs.select("query", "asked", "id", "data")).mapInArrow(_nearest(k), "query_id long, rank int, vec_id long, score double")
