"""Connected components of a graph given as pairs, by alternating large-star and small-star steps.

Each step is an aggregation and a join on edges, written to the shared folder; the number of rounds is logarithmic in
practice. Nothing is collected: the driver sees only a checksum of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import dropped, staged


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x or 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it is connected with) of all nodes of edges (a, b: long); null ends and loops are ignored."""
    spark = edges.sparkSession
    now, path = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        after, next_path = staged(small.where("a <> b").distinct(), "edges")
        dropped(spark, path)
        now, path, was, mark = after, next_path, mark, _mark(after)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out, _ = staged(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
    dropped(spark, path)
    return out
