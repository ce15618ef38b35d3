"""Optimal assignment: many problems in parallel, each solved in one task by shortest augmenting paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.rows import minkowski


def solve(cost: np.ndarray) -> np.ndarray:
    """The column of each row of a finite matrix, of no more rows than columns, so that the sum is least; columns too many stay free."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, np.int64)  # rows count from 1; 0 is free
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        slack, via, done = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while row_of[at]:
            done[at] = True
            r = row_of[at]
            left = ~done[1:]
            reduced = cost[r - 1] - u[r] - v[1:]
            nearer = left & (reduced < slack[1:])
            slack[1:][nearer] = reduced[nearer]
            via[1:][nearer] = at
            following = 1 + int(np.argmin(np.where(left, slack[1:], np.inf)))
            step = slack[following]
            u[row_of[done]] += step
            v[done] -= step
            slack[1:][left] -= step
            at = following
        while at:
            row_of[at] = row_of[via[at]]
            at = via[at]
    out = np.empty(n, np.int64)
    taken = np.flatnonzero(row_of[1:])
    out[row_of[1:][taken] - 1] = taken
    return out


def mincost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost. +inf forbids a pair, -inf forces one where possible; missing rows or columns of an oblong matrix stay alone."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    big = 2 * (max(cost.shape) + np.abs(cost[np.isfinite(cost)]).sum())
    finite = np.where(np.isposinf(cost), big, np.where(np.isneginf(cost), -big, cost))
    if cost.shape[0] > cost.shape[1]:  # the fewer are assigned one after another, the more are not filled up to a square
        pairs = sorted((int(i), j) for j, i in enumerate(solve(finite.T)))
    else:
        pairs = [(i, int(j)) for i, j in enumerate(solve(finite))]
    return [(i, j) for i, j in pairs if not np.isposinf(cost[i, j])]


def _assigned(edges: DataFrame, problem: list[str], i: str, j: str, weight: str, sign: int) -> DataFrame:
    kinds = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = sorted(pdf[i].unique()), sorted(pdf[j].unique())
        m = np.full((len(rows), len(columns)), np.inf if sign > 0 else 0.0)  # by value a pair more is no aim
        value = sign * pdf[weight].to_numpy(float)
        usable = value < 0 if sign < 0 else np.ones(len(value), bool)
        m[np.searchsorted(rows, pdf[i].to_numpy()[usable]), np.searchsorted(columns, pdf[j].to_numpy()[usable])] = value[usable]
        found = [(a, b) for a, b in mincost(m) if sign > 0 or m[a, b] < 0]
        out = pd.DataFrame({i: [rows[a] for a, _ in found], j: [columns[b] for _, b in found], weight: [sign * m[a, b] for a, b in found]})
        for p in problem:
            out[p] = pdf[p].iloc[0]
        return out[[*problem, i, j, weight]]

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*problem, i, j]] + [f"`{weight}` double"])
    return edges.groupBy(*problem).applyInPandas(run, schema)


def mincost_assignment(edges: DataFrame, problem: list[str], i: str, j: str, cost: str) -> DataFrame:
    """The pairs of least total cost of each problem; absent pairs cost +inf. A problem must fit a task's memory."""
    return _assigned(edges, problem, i, j, cost, 1)


def maxvalue_assignment(edges: DataFrame, problem: list[str], i: str, j: str, value: str) -> DataFrame:
    """The pairs of greatest total value of each problem, however few; values of 0 or less aren't assigned."""
    return _assigned(edges, problem, i, j, value, -1)


def mindist_assignment(left: DataFrame, right: DataFrame, problem: list[str], left_id: str, right_id: str, left_vec: str, right_vec: str, p: float = 2) -> DataFrame:
    """Pairs of least total Minkowski distance between the vectors of either side of each problem."""
    pairs = left.select(*problem, left_id, F.col(left_vec).alias("_a")).join(right.select(*problem, right_id, F.col(right_vec).alias("_b")), problem)
    return mincost_assignment(pairs.select(*problem, left_id, right_id, minkowski("_a", "_b", p).alias("dist")), problem, left_id, right_id, "dist")
