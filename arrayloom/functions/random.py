"""Random numbers that depend on a seed and a row's id alone, however rows are partitioned, and what is drawn with them."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions.elementwise import _c
from arrayloom.sources.frames import with_positions


def ensure_seed(seed: int | str | float | None = None) -> int:
    """Any seed as an integer: text by its md5, a float by its fraction; None is 0."""
    if seed is None:
        return 0
    if isinstance(seed, bool) or not isinstance(seed, (int, str, float)):
        raise TypeError(f"no seed: {seed!r}")
    if isinstance(seed, str):
        return int(hashlib.md5(seed.encode()).hexdigest(), 16) % (2**32 - 1)
    if isinstance(seed, float):
        a, b = seed.as_integer_ratio()
        return (a * 2**32 + b) % (2**32 - 1)
    return seed % (2**32 - 1)


def seed_global(spark: SparkSession, seed: int | str | float, offset: int = 0) -> int:
    """The session's seed, for draws without one of their own."""
    spark.conf.set("arrayloom.seed", str(ensure_seed(seed) + offset))
    return ensure_seed(seed) + offset


def session_seed(seed: int | str | None = None):
    """A seed as it is; without one the session's (seed_global), or 0."""
    if seed is not None:
        return seed
    spark = SparkSession.getActiveSession()
    return int(spark.conf.get("arrayloom.seed", "0")) if spark is not None else 0


def hash_uniform(row: Column | str, seed: int | str | None = None) -> Column:
    """Uniform in (0, 1): the first 32 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{session_seed(seed)}:"), _c(row).cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def uniform(row, low: float = 0.0, high: float = 1.0, seed: int | None = None, dtype: str = "double") -> Column:
    if dtype not in ("float", "double"):
        raise ValueError(dtype)
    return (F.lit(float(low)) + hash_uniform(row, seed) * F.lit(float(high) - float(low))).cast(dtype)


def uniform32(row, low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    return uniform(row, low, high, seed, "float")


def standard_normal(row, mean: float = 0.0, std: float = 1.0, seed: int | None = None, dtype: str = "double") -> Column:
    """Box and Muller's transform of two uniform numbers."""
    if dtype not in ("float", "double"):
        raise ValueError(dtype)
    u, v = hash_uniform(row, seed), hash_uniform(F.concat(_c(row).cast("string"), F.lit("'")), seed)
    z = F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)
    return (z * F.lit(float(std)) + F.lit(float(mean))).cast(dtype)


def standard_normal32(row, mean: float = 0.0, std: float = 1.0, seed: int | None = None) -> Column:
    return standard_normal(row, mean, std, seed, "float")


def standard_normal64(row, mean: float = 0.0, std: float = 1.0, seed: int | None = None) -> Column:
    return standard_normal(row, mean, std, seed)


def hash_whole(row: Column | str, below: int, seed: int | str | None = None) -> Column:
    """A whole number from 0 to below - 1: 60 bits of md5(seed:id), modulo `below` (a bias of at most below / 2^60)."""
    digest = F.md5(F.concat(F.lit(f"{session_seed(seed)}:"), _c(row).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(below)


def shuffled(df: DataFrame, row: str, seed: int | None = None) -> DataFrame:
    """df with positions in an order that depends on the seed: a range-partitioned sort, no single task."""
    columns = df.columns
    return with_positions(df.withColumn("_u", hash_uniform(row, seed)), ["_u", row]).select("pos", *columns)


def _drawn(spark: SparkSession, num: int, draw) -> DataFrame:
    """The first num different rows of draw(df), a frame with the numbers of draws; more are drawn until there are enough."""
    tries = 2 * num + 64
    while True:
        made = draw(spark.range(tries).withColumnRenamed("id", "_draw"))
        keys = [c for c in made.columns if c != "_draw"]
        different = made.groupBy(*keys).agg(F.min("_draw").alias("_draw"))
        if different.count() >= num:
            return different.orderBy("_draw").limit(num).select(*keys)
        tries *= 4


def random_combinations(items: DataFrame, item: str, size: int, num: int, seed: int | None = None) -> DataFrame:
    """num distinct sorted combinations of `size` different items, drawn by hash.

    Where num is a good part of them, joins on order make all combinations; else places of items are drawn at random, and
    draws with a repeated place, or of a combination drawn before, are drawn again.
    """
    spark, seed = items.sparkSession, session_seed(seed)
    base = items.select(F.col(item).alias("x")).distinct()
    n = base.count()
    names = [f"c{i}" for i in range(size)]
    if 4 * num >= math.comb(n, size):
        out = base.withColumnRenamed("x", "c0")
        for i in range(1, size):
            out = out.join(base, F.col("x") > F.col(f"c{i - 1}")).withColumnRenamed("x", f"c{i}")
        key = F.concat_ws(",", *[F.col(c).cast("string") for c in names])
        return out.withColumn("_u", hash_uniform(key, seed)).orderBy("_u", *names).limit(num).drop("_u")
    placed = with_positions(base, ["x"])

    def draw(numbers: DataFrame) -> DataFrame:
        places = F.array_sort(F.array(*[hash_whole(F.concat_ws(",", F.col("_draw").cast("string"), F.lit(str(i))), n, seed) for i in range(size)]))
        return numbers.withColumn("_p", places).where(F.size(F.array_distinct("_p")) == size).select("_draw", *[F.col("_p")[i].alias(c) for i, c in enumerate(names)])

    out = _drawn(spark, num, draw)
    for c in names:
        out = out.join(placed.select(F.col("pos").alias(c), F.col("x").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*names)


def random_product(spark: SparkSession, axes: list[list], num: int, seed: int | None = None) -> DataFrame:
    """num distinct tuples of a cartesian product: flat numbers are drawn without repetition, then taken apart."""
    total, seed = math.prod(map(len, axes)), session_seed(seed)
    num = min(num, total)
    if 2 * num >= total or total <= 100:
        flat = spark.range(total).withColumn("_u", hash_uniform("id", seed)).orderBy("_u", "id").limit(num)
    else:
        flat = _drawn(spark, num, lambda numbers: numbers.withColumn("id", hash_whole("_draw", total, seed)))
    cols, below = [], total
    for i, axis in enumerate(axes):
        below //= len(axis)
        cols.append(F.get(F.array(*[F.lit(x) for x in axis]), F.expr(f"cast((id div {below}) % {len(axis)} as int)")).alias(f"c{i}"))
    return flat.select(*cols)
