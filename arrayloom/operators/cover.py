"""Weighted set cover: greedily as a loop of aggregations, or exactly by branch and bound, many problems in parallel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.sources.store import settled


def greedy_cover(sets: DataFrame, set_id: str, item: str, values: DataFrame | None = None, weights: dict | None = None, max_weight: float | None = None) -> list:
    """Set ids in the order chosen: each time the set of most uncovered value, ties to the smallest id.

    sets: a row for each item of each set. values: item, value (else each item is worth 1). weights bound the whole: the
    loop ends once they reach max_weight, or when no set adds anything. Each round is one aggregation; the driver sees a
    row of it. What is left is settled every few rounds so that plans stay short.
    """
    rows = sets.select(F.col(set_id).alias("s"), F.col(item).alias("x")).distinct()
    if values is not None:
        names = values.columns
        rows = rows.join(values.select(F.col(names[0]).alias("x"), F.col(names[1]).cast("double").alias("value")), "x")
    else:
        rows = rows.withColumn("value", F.lit(1.0))
    left, chosen, weight = rows, [], 0.0
    while max_weight is None or weight < max_weight:
        best = left.groupBy("s").agg(F.sum("value").alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "s").first()
        if best is None:
            break
        chosen.append(best.s)
        weight += (weights or {}).get(best.s, 1)
        covered = rows.where(F.col("s") == F.lit(best.s)).select("x")
        left = left.join(covered, "x", "left_anti").where(F.col("s") != F.lit(best.s))
        if len(chosen) % 4 == 0:
            left = settled(left)
    return chosen


def exact_cover(sets: dict, values: dict | None = None, weights: dict | None = None, max_weight: float | None = None) -> list:
    """The best choice of sets, in one process; branch and bound takes longer the more sets overlap.

    Without max_weight: as few sets as cover every item. With it: the most value within the weight, then fewer sets.
    """
    items = sorted({x for s in sets.values() for x in s}, key=str)
    number = {x: i for i, x in enumerate(items)}
    worth = [1.0 if values is None else float(values.get(x, 0)) for x in items]
    cost = {s: 1.0 if weights is None else float(weights.get(s, 1)) for s in sets}
    masks = {s: sum(1 << number[x] for x in set(members)) for s, members in sets.items()}
    everything = (1 << len(items)) - 1

    def value(mask: int) -> float:
        return sum(w for i, w in enumerate(worth) if mask >> i & 1)

    if max_weight is None:
        best = list(sets)

        def cover(mask: int, chosen: list) -> None:
            nonlocal best
            if mask == everything:
                if len(chosen) < len(best) or (len(chosen) == len(best) and sorted(chosen, key=str) < sorted(best, key=str)):
                    best = list(chosen)
                return
            rest = everything & ~mask
            widest = max((m & rest).bit_count() for m in masks.values())
            if len(chosen) + -(-rest.bit_count() // max(widest, 1)) > len(best):
                return
            rare = min((i for i in range(len(items)) if rest >> i & 1), key=lambda i: sum(m >> i & 1 for m in masks.values()))
            for s in sorted(masks, key=str):
                if masks[s] >> rare & 1:
                    cover(mask | masks[s], [*chosen, s])

        cover(0, [])
        return sorted(best, key=str)

    order = sorted(sets, key=lambda s: (-value(masks[s]), str(s)))
    best, best_key = [], (0.0, 0)
    reach = [0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        reach[i] = reach[i + 1] | masks[order[i]]

    def choose(i: int, mask: int, weight: float, chosen: list) -> None:
        nonlocal best, best_key
        key = (value(mask), -len(chosen))
        if key > best_key:
            best, best_key = list(chosen), key
        if i == len(order) or value(mask | reach[i]) < best_key[0]:
            return
        s = order[i]
        if weight + cost[s] <= max_weight and masks[s] & ~mask:
            choose(i + 1, mask | masks[s], weight + cost[s], [*chosen, s])
        choose(i + 1, mask, weight, chosen)

    choose(0, 0, 0.0, [])
    return sorted(best, key=str)


def exact_covers(sets: DataFrame, problem: list[str], set_id: str, item: str, values: DataFrame | None = None, weights: dict | None = None, max_weight: float | None = None) -> DataFrame:
    """problem, step, set: the best choice of sets of each problem, in order; each problem is solved in one task.

    sets: a row for each item of each set. values: item, value.
    """
    rows = sets.select(*problem, F.col(set_id).alias("set_id"), F.col(item).alias("item")).distinct()
    if values is not None:
        rows = rows.join(values.select(F.col(values.columns[0]).alias("item"), F.col(values.columns[1]).cast("double").alias("value")), "item", "left").fillna(0.0, ["value"])
    else:
        rows = rows.withColumn("value", F.lit(1.0))
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members: dict = {}
        for s, x in zip(pdf["set_id"].tolist(), pdf["item"].tolist(), strict=True):
            members.setdefault(s, []).append(x)
        found = exact_cover(members, dict(zip(pdf["item"].tolist(), pdf["value"].tolist(), strict=True)), weights, max_weight)
        out = pd.DataFrame({"step": range(len(found)), "set_id": pd.Series(found, dtype=pdf["set_id"].dtype)})
        for p in problem:
            out[p] = pdf[p].iloc[0]
        return out[[*problem, "step", "set_id"]]

    schema = ", ".join([*(f"`{p}` {kinds[p]}" for p in problem), "step int", f"set_id {kinds['set_id']}"])
    return rows.groupBy(*problem).applyInPandas(run, schema)


def setcover(sets: DataFrame, set_id: str, item: str, algo: str = "approx", values: DataFrame | None = None, weights: dict | None = None, max_weight: float | None = None) -> list:
    """approx or greedy: greedy_cover; exact or ilp: exact_covers of one problem, which a task must hold."""
    if algo in ("approx", "greedy"):
        return greedy_cover(sets, set_id, item, values, weights, max_weight)
    if algo not in ("exact", "ilp"):
        raise KeyError(algo)
    found = exact_covers(sets.withColumn("_problem", F.lit(0)), ["_problem"], set_id, item, values, weights, max_weight)
    return [r.set_id for r in found.orderBy("step").collect()]  # as many rows as sets are chosen
