"""Small cases with known answers, and comparisons with NumPy and brute force."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.functions import distributions as D
from arrayloom.functions import elementwise as E
from arrayloom.functions import random as N
from arrayloom.functions import rows as R
from arrayloom.operators import arrays, assign, cover, groups, robust, slices, slider, stats, topk
from arrayloom.operators import tensor as T
from arrayloom.operators.frame import Frame
from arrayloom.operators.tensor import Tensor


def numbered(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame([(i, *[c[i] for c in columns.values()]) for i in range(n)], ["pos", *columns])


def values(df, *columns, order=None):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy(*(order or columns)).select(*columns).collect()]


def test_group_items(spark):
    df = numbered(spark, item=[0, 1, 2, 3, 4, 5, 6, 7, 1, 1], key=[2, 2, 1, 1, 0, 1, 0, 1, 1, 1])
    assert values(groups.group_items(df, "key", "item", "pos"), "key", "items") == [(0, [4, 6]), (1, [2, 3, 5, 7, 1, 1]), (2, [0, 1])]


def test_group_indices(spark):
    df = numbered(spark, key=[2, 1, 2, 1, 2, 1, 2, 3, 3, 3, 3], item=[1, 8, 5, 5, 8, 6, 7, 5, 3, 0, 9])
    found = groups.group_indices(df, "key", "pos")
    assert values(found, "key", "indices") == [(1, [1, 3, 5]), (2, [0, 2, 4, 6]), (3, [7, 8, 9, 10])]
    assert values(groups.apply_grouping(df, "item", "pos", found, "key", "indices"), "key", "items") == [(1, [8, 5, 6]), (2, [1, 5, 8, 7]), (3, [5, 3, 0, 9])]


@pytest.mark.parametrize(("given", "offset", "n"), [([1, 2, 3, 5, 6, 7, 8, 9, 10, 15, 99, 100, 101], 1, 4), ([0, 0, 3, 0, 0, 7, 2, 3, 4, 4, 4, 1, 1], 1, 11), ([0, 0, 3, 0, 0, 7, 2, 3, 4, 4, 4, 1, 1], 0, 8)])
def test_islands(spark, given, offset, n):
    df = numbered(spark, v=given).withColumn("g", F.lit(0))
    assert groups.group_consecutive_indices(df, "v", "pos", ["g"], offset).count() == n


def test_flat_round_trip(spark):
    lengths = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, 3)], "outer_no bigint, n bigint").withColumn("g", F.lit(0))
    bounds = groups.flat_bounds(lengths, "outer_no", "n", ["g"])
    at = groups.flat_unravel(spark.range(8).withColumnRenamed("id", "flat"), bounds, "outer_no", "flat", bucket=2)
    assert values(at, "flat", "outer", "inner") == [(0, 0, 0), (1, 2, 0), (2, 2, 1), (3, 3, 0), (4, 3, 1), (5, 3, 2)]
    back = groups.flat_ravel(at.select(F.col("outer").alias("outer_no"), "inner", F.col("flat").alias("was")), bounds, "outer_no", "inner")
    assert all(a == b for a, b in values(back, "was", "flat"))


def test_running_statistics(spark):
    cells = [(r, i, j, float(x), float(w)) for r in range(3) for (i, j), x, w in zip(itertools.product(range(4), range(2)), [1, 1, 1, 1, 0, 0, 0, 1], [1, 0, 0, 1, 0, 1, 1, 1])]
    df = spark.createDataFrame(cells, "rep int, d0 int, d1 int, v double, w double")
    states = stats.running(df, "v", by=["d0", "d1"])
    assert stats.summary(stats.merged(states)).first()["mean"] == 0.625
    assert values(stats.summary(stats.merged(states, ["d0"])), "d0", "mean") == [(0, 1.0), (1, 1.0), (2, 0.0), (3, 0.5)]
    weighted = stats.summary(stats.running(df, "v", "w")).first()["mean"]
    assert weighted == pytest.approx(np.average([c[3] for c in cells], weights=[c[4] for c in cells]))
    with pytest.raises(KeyError):
        stats.running(df, "v", nan_policy="other")


def test_running_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,)], "v double")
    assert stats.summary(stats.running(df, "v")).first()["mean"] == 2.0
    assert math.isnan(stats.summary(stats.running(df, "v", nan_policy="propagate")).first()["mean"])


def test_pooled_without_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1e8, 0.0), (4.0, 1.0, 5.0)], "m double, s double, n double")
    row = stats.combine_mean_stds(df, "m", "s", "n", variance=True).first()
    assert row["mean"] == pytest.approx((3 + 20) / 8)
    assert row["std"] == pytest.approx(math.sqrt((2 * 4 + 4 * 1 + 3 * (1 - 23 / 8) ** 2 + 5 * (4 - 23 / 8) ** 2) / 7))


def test_normalize_like_numpy(spark):
    x = np.random.default_rng(0).normal(size=50)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    got = values(robust.normalize(df, "v"), "i", "normalized")
    assert np.allclose([v for _, v in got], (x - x.min()) / (x.max() - x.min()))
    flat = spark.createDataFrame([(0, 3.0), (1, 3.0)], "i int, v double")
    assert values(robust.normalize(flat, "v"), "i", "normalized") == [(0, 0.0), (1, 0.0)]
    assert robust.normalize(flat.limit(0), "v").count() == 0


def test_robust_mask_equals_nan(spark):
    x = np.random.default_rng(1).random(60)
    bad = np.arange(60) % 2 == 0
    a = spark.createDataFrame([(i, float(v), bool(not b)) for i, (v, b) in enumerate(zip(x, bad))], "i int, v double, ok boolean")
    b = spark.createDataFrame([(i, math.nan if bb else float(v)) for i, (v, bb) in enumerate(zip(x, bad))], "i int, v double")
    one = dict(values(robust.robust_normalize(a, "v", valid=F.col("ok")), "i", "normalized"))
    two = dict(values(robust.robust_normalize(b, "v"), "i", "normalized"))
    assert all(one[i] == pytest.approx(two[i]) for i in range(60) if not bad[i])
    assert all(one[i] == pytest.approx(float(x[i])) and math.isnan(two[i]) for i in range(60) if bad[i])


def test_topk_against_sort(spark):
    v = [5, 1, 5, 3, 2, 5]
    df = numbered(spark, v=v)
    for k in (0, 1, 3, 9):
        assert [r.pos for r in topk.argmaxima(df, "v", ["pos"], k).collect()] == sorted(range(6), key=lambda i: (-v[i], i))[:k]
    with pytest.raises(IndexError):
        topk.argminima(df, "v", ["pos"], -1)
    keys = numbered(spark, a=[1, 3, 3], b=[2, 2, 2])
    assert topk.arglexmax(keys, ["a", "b"], "pos").first()[0] == 1
    assert values(topk.arglexmax(keys, ["a", "b"], "pos", multi=True), "pos") == [1, 2]


def test_masks(spark):
    df = spark.createDataFrame([(0,), (1,), (4,)], "i int")
    assert [f for _, f in values(topk.boolmask(df, "i", 6), "pos", "flag")] == [True, True, False, False, True, False]
    row = spark.range(1).select(R.boolmask(F.array(F.lit(0), F.lit(1), F.lit(4))).alias("m"), R.isect_flags(F.array(*map(F.lit, [1, 2, 3, 4])), [1, 4, 6]).alias("f"), E.isect_flags(F.lit(1), []).alias("none")).first()
    assert row.m == [True, True, False, False, True] and row.f == [True, False, False, True] and row.none is False


def test_set_cover(spark):
    sets = {"a": [1, 2, 3, 8, 9, 0], "b": [1, 2, 3, 4, 5], "c": [4, 5, 7], "d": [5, 6, 7], "e": [6, 7, 8, 9, 0]}
    df = spark.createDataFrame([(s, x) for s, xs in sets.items() for x in xs], "s string, x int")
    assert cover.setcover(df, "s", "x") == ["a", "c", "d"]
    assert cover.setcover(df, "s", "x", algo="exact") == ["b", "e"]
    assert cover.setcover(df, "s", "x", max_weight=1) == ["a"]
    assert cover.exact_cover(sets, weights={"a": 3}, max_weight=2) == ["b", "e"]
    with pytest.raises(KeyError):
        cover.setcover(df, "s", "x", algo="other")


def best_by_brute_force(cost):
    n, m = cost.shape
    if n <= m:
        return min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    return best_by_brute_force(cost.T)


@pytest.mark.parametrize("shape", [(1, 1), (3, 4), (5, 5), (6, 3)])
def test_assignment_against_brute_force(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = np.round(rng.normal(size=shape) * 10)
        found = assign.mincost(cost)
        assert len(found) == min(shape)
        assert sum(cost[i, j] for i, j in found) == pytest.approx(best_by_brute_force(cost))


def test_assignment_infinities():
    inf = np.inf
    assert assign.mincost(np.array([[inf]])) == []
    cost = np.array([[inf, 1.0], [inf, 2.0]])
    assert assign.mincost(cost) == [(0, 1)]
    assert assign.mincost(np.array([[3.0, -inf], [1.0, 1.0]])) == [(0, 1), (1, 0)]


def test_assignment_frames(spark):
    cost = [[3, 2, 1, 9], [2, 1, 9, 9], [9, 9, 9, 3]]
    edges = spark.createDataFrame([(0, i, j, float(c)) for i, r in enumerate(cost) for j, c in enumerate(r)], "p int, i int, j int, c double")
    assert values(assign.mincost_assignment(edges, ["p"], "i", "j", "c"), "i", "j") == [(0, 2), (1, 1), (2, 3)]
    top = values(assign.maxvalue_assignment(edges.withColumn("c", F.col("c") - 5), ["p"], "i", "j", "c"), "i", "j", "c")
    assert sum(c for _, _, c in top) == 12.0 and all(c > 0 for _, _, c in top)


def test_assignment_by_value_prefers_value_to_pairs(spark):
    inf = np.inf
    worth = {0: [[10, 1], [1, 0]], 1: [[9, 2, 1, 3], [4, 1, 5, 5], [9, 9, 2, 4], [-1, -1, -1, -1]], 2: [[inf]], 3: [[0]], 4: [[8, 3, -1], [3, -2, -5]]}
    edges = spark.createDataFrame([(p, i, j, float(v)) for p, m in worth.items() for i, r in enumerate(m) for j, v in enumerate(r)], "p int, i int, j int, v double")
    found = assign.maxvalue_assignment(edges, ["p"], "i", "j", "v").collect()
    assert all(r.v > 0 for r in found)
    assert {p: sum(r.v for r in found if r.p == p) for p in worth} == {0: 10.0, 1: 23.0, 2: inf, 3: 0, 4: 8.0}
    rng = np.random.default_rng(9)
    for shape in [(2, 3), (4, 4), (5, 3)] * 4:
        m = np.round(rng.normal(size=shape) * 10)
        edges = spark.createDataFrame([(0, i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "p int, i int, j int, v double").coalesce(1)
        total = sum(r.v for r in assign.maxvalue_assignment(edges, ["p"], "i", "j", "v").collect())
        assert total == pytest.approx(-best_by_brute_force(-np.maximum(m, 0)))


def test_assignment_by_value_of_few_to_many(spark):
    """Four rows and 900 columns: of each row only the four best columns can matter; a square of 900 takes minutes."""
    worth = np.random.default_rng(21).integers(1, 10**6, (4, 900)).astype(float)
    edges = spark.createDataFrame([(0, i, j, float(v)) for (i, j), v in np.ndenumerate(worth)], "p int, i int, j int, v double").coalesce(1)
    best = np.unique(np.argsort(-worth, axis=1)[:, :4])
    began = time.monotonic()
    found = assign.maxvalue_assignment(edges, ["p"], "i", "j", "v").collect()
    assert time.monotonic() - began < 10
    assert sum(r.v for r in found) == -best_by_brute_force(-worth[:, best])


def test_assignment_by_cost_of_many_to_few():
    """The same by cost, with either side the longer one, forbidden pairs and a forced one."""
    cost = np.random.default_rng(22).integers(1, 10**6, (4, 900)).astype(float)
    cost[1, ::3], cost[2, 5] = np.inf, -np.inf
    best = np.unique(np.argsort(cost, axis=1)[:, :4])
    finite = np.where(np.isneginf(cost), -(10.0**8), cost)
    began = time.monotonic()
    for m, pairs in ((cost, assign.mincost(cost)), (cost.T, [(j, i) for i, j in assign.mincost(cost.T)])):
        assert sorted(pairs)[2] == (2, 5) and len(pairs) == 4 == len({j for _, j in pairs})
        assert sum(finite[i, j] for i, j in pairs) == best_by_brute_force(finite[:, best])
        assert assign.mincost(m) == sorted(assign.mincost(m))
    assert time.monotonic() - began < 10


def test_windows():
    w = slider.SlidingWindow((10, 10), (5, 5))
    assert [tuple((s.start, s.stop) for s in x) for x in w] == [((0, 5), (0, 5)), ((0, 5), (5, 10)), ((5, 10), (0, 5)), ((5, 10), (5, 10))]
    w = slider.SlidingWindow((16, 16), (4, 4), overlap=(0.5, 0.25))
    assert w.stride == (2, 3) and w.grid_shape == (7, 5) and w[-1] == w[34]
    assert list(slider.SlidingWindow((4, 4), (3, 3), stride=1).centers) == [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    assert slider.SlidingWindow((3, 3), (None, 2), keepbound=True, allow_overshoot=True).grid_shape == (1, 2)
    for bad in ({"overlap": 1.0}, {"stride": 0}, {"overlap": 0.5, "stride": 1}, {"stride": 3}):
        with pytest.raises(ValueError):
            slider.SlidingWindow((10,), (4,), **bad) if bad != {"stride": 3} else slider.SlidingWindow((11,), (4,), **bad)


@pytest.mark.parametrize(("n", "w", "s", "keep"), [(10, 4, 3, True), (10, 4, 3, False), (11, 4, 3, True), (9, 2, 5, True), (3, 7, 2, True)])
def test_window_frames_and_cover(spark, n, w, s, keep):
    window = slider.SlidingWindow((n,), (w,), stride=s, keepbound=keep, allow_overshoot=True)
    starts = values(window.frame(spark), "start0")
    assert starts == window.starts[0]
    cells = spark.range(n).select(F.col("id").alias("d0"))
    got = sorted((r.d0, r.start0) for r in window.cover(cells, ["d0"]).collect())
    assert got == sorted((i, a) for a in starts for i in range(a, min(a + w, n)))


def test_stitch(spark):
    cells = [(i, j, 2.0) for i in range(4) for j in range(4)] + [(i, j, 3.0) for i in (0, 2) for j in range(4)] + [(i, 0, 3.0) for i in range(4)]
    grid = slider.stitch_grid(spark.createDataFrame(cells, "d0 bigint, d1 bigint, v double"), (4, 4))
    want = np.zeros((4, 4)), np.zeros((4, 4))
    for i, j, v in cells:
        want[0][i, j] += v
        want[1][i, j] += 1
    assert np.allclose(Tensor(grid, (4, 4)).numpy(), want[0] / want[1])


def test_slices(spark):
    df = numbered(spark, v=[0, 1, 2, 3, 4])
    assert [v for _, v in values(slices.padded_slice(df, "pos", "v", -2, 7), "pos", "v")] == [0, 0, 0, 1, 2, 3, 4, 0, 0]
    row = spark.range(1).select(R.padded_slice(F.array(*map(F.lit, range(5))), 3, 4, 1, 0).alias("a"), R.padded_slice(F.array(*map(F.lit, range(5))), -2, 7, 3, 3).alias("b")).first()
    assert row.a == [2, 3] and row.b == [0] * 5 + [0, 1, 2, 3, 4] + [0] * 5
    inside, extra = slices.embed_slice([(-10, 400), (5, 20)], [300, 300], 3)
    assert inside == [(0, 300), (2, 23)] and extra == [(13, 103), (0, 0)]
    with pytest.raises(ValueError):
        slices.embed_slice([(5, 2)], [10])


def test_one_hot(spark):
    df = spark.createDataFrame([(x,) for x in (0, 4, 2, -1)], "x int")
    assert [r[0] for r in df.select(R.one_hot("x", 5)).collect()] == [np.eye(5)[x].tolist() for x in (0, 4, 2, -1)]
    with pytest.raises(Exception, match="label"):
        spark.createDataFrame([(5,)], "x int").select(R.one_hot("x", 5)).collect()


@pytest.mark.parametrize("axis", [0, 1, 2, None])
def test_tensor_reductions(spark, axis):
    data = np.random.default_rng(4).integers(0, 5, (2, 3, 4)).astype(float)
    t = Tensor.from_numpy(spark, data)
    for name in ("sum", "max", "min", "argmax", "argmin"):
        assert np.array_equal(getattr(t, name)(axis).numpy(), getattr(np, name)(data, axis=axis)), name
    if axis is not None:
        assert np.array_equal(t.argsort(axis).numpy(), np.argsort(data, axis=axis, kind="stable"))
        e = np.exp(data - data.max(axis=axis, keepdims=True))
        assert np.allclose(t.softmax(axis).numpy(), e / e.sum(axis=axis, keepdims=True))


def test_tensor_shapes(spark):
    data = np.arange(12).reshape(3, 4)
    t = Tensor.from_numpy(spark, data)
    assert np.array_equal(t.T.numpy(), data.T) and np.array_equal(t.view(2, -1).numpy(), data.reshape(2, 6))
    assert np.array_equal(t.take([2, 0, 0], 0).numpy(), data[[2, 0, 0]]) and np.array_equal(t.take([5, -1]).numpy(), data.ravel()[[5, -1]])
    assert np.array_equal(t.tile((2, 1, 2)).numpy(), np.tile(data, (2, 1, 2))) and np.array_equal(t.repeat(2, 0).numpy(), data.repeat(2, 0))
    assert np.array_equal(T.cat([t, t], 1).numpy(), np.concatenate([data, data], 1)) and np.array_equal(t.pad([(1, 0), (0, 2)], 7).numpy(), np.pad(data, [(1, 0), (0, 2)], constant_values=7))
    assert np.array_equal(t.matmul(t.T).numpy(), data @ data.T) and np.array_equal(t.kron(t).numpy(), np.kron(data, data))
    assert t.array_equal(t) and not t.array_equal(t.T) and t.atleast_nd(3).shape == (3, 4, 1)
    with pytest.raises(ValueError):
        t.view(5, 5)


def test_elementwise_special_values(spark):
    df = spark.createDataFrame([(x,) for x in (math.nan, math.inf, -math.inf, 0.0, -1.5, 2.5)], "x double")
    got = df.select(E.log("x"), E.floor("x"), E.ceil("x"), E.trunc("x"), E.clip("x", -1.0, 1.0), E.nan_to_num("x"), E.round_even("x"), E.divide("x", F.lit(0.0))).collect()
    x = np.array([r[0] for r in df.collect()])
    with np.errstate(all="ignore"):
        want = [np.log(x), np.floor(x), np.ceil(x), np.trunc(x), np.clip(x, -1, 1), np.nan_to_num(x), np.round(x), x / 0.0]
    for i, w in enumerate(want):
        assert np.array_equal(np.array([r[i] for r in got], float), w, equal_nan=True), i


def test_frames(spark):
    f = Frame.make(spark, {"foo": [0] * 7, "bar": [i % 3 for i in range(7)], "baz": [2.73] * 7})
    assert len(f) == 7 and f.columns == ["foo", "bar", "baz"] and "bar" in f and "nope" not in f
    assert f.take([0, 2, 3]).to_dict("list")["bar"] == [0, 2, 0] and f.iloc(4).first()["bar"] == 1
    assert f.union(f).to_dict("list")["bar"] == [0, 1, 2, 0, 1, 2, 0] * 2 and len(f) == 7
    assert f.sort_values("bar", ascending=False).to_dict("list")["bar"] == [2, 2, 1, 1, 0, 0, 0]
    assert f.same_rows(f.copy()) and not f.same_rows(f.clear())
    assert f.compress([True] + [False] * 6).to_dict() == {0: {"foo": 0, "bar": 0, "baz": 2.73}}
    assert [r["bar"] for _, r in f.iterrows()] == [0, 1, 2, 0, 1, 2, 0]
    with pytest.raises(KeyError):
        f.extend(Frame.make(spark, {"foo": [1]}))
    with pytest.raises(KeyError):
        Frame.from_dict(spark, [{"a": 1}, {"b": 2}])
    with pytest.raises(ValueError):
        Frame.make(spark, {"a": [1], "b": [1, 2]})
    assert Frame.make(spark, columns=["a", "b"]).columns == ["a", "b"]


def test_distributions(spark):
    draws = spark.range(4000).select(D.Normal(10, 3).sample("id", 1).alias("n"), D.TruncNormal(0, 1, -0.5, 2).sample("id", 1).alias("t"), D.Binomial(0.25, 8).sample("id", 1).alias("b"), D.Exponential(2).sample("id", 1).alias("e")).toPandas()
    assert abs(draws.n.mean() - 10) < 0.2 and abs(draws.n.std() - 3) < 0.2
    assert draws.t.min() >= -0.5 and draws.t.max() <= 2
    assert abs(draws.b.mean() - 2) < 0.1 and abs(draws.e.mean() - 2) < 0.15
    assert isinstance(D.Uniform.coerce(3), D.Uniform) and D.Normal.coerce([1, 2]).mean == 1 and D.Normal.coerce({"std": 4}).std == 4
    with pytest.raises(D.CoerceError):
        D.Normal.coerce("x")
    with pytest.raises(ValueError):
        D.Bernoulli(1.5)
    with pytest.raises(NotImplementedError):
        D.Normal() % 2
    assert isinstance(D.Distribution.random(3), D.Distribution) and D.Distribution.seeded(3).Uniform(2).own_seed == 3
    assert dict((D.Normal(1) + 2).parameters())["operation"] == "add"


def test_seeds():
    assert N.ensure_seed(None) == 0 and N.ensure_seed("a") == N.ensure_seed("a") != N.ensure_seed("b") and N.ensure_seed(0.5) != N.ensure_seed(0.25)
    with pytest.raises(TypeError):
        N.ensure_seed([1])


def test_dtypes():
    assert T.result_type("int32", "float32") == "float64" and T.dtype_info("uint16")["max"] == 65535 and T.dtype_kind("bigint") == "i"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from arrayloom.streaming import running

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    make = lambda df: running.windowed(df, "ts", "value", ["event_type"], "1 day", "1 day")
    streamed = running.run_once(spark, str(tmp_path / "events"), events.schema, make, "running_by_day")
    columns = ["start", "event_type", "n", "total"]
    rounded = lambda df: sorted((str(r[0]), r[1], r[2], round(r[3], 4)) for r in df.select(*columns).collect())
    assert rounded(streamed) == rounded(make(events))


def test_plans_push_down(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 30")
    plan = stats.running(df, "l_extendedprice", by=["l_returnflag"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in plan and "l_comment" not in plan and "Python" not in plan


def test_padding_modes_as_numpy_has_them(spark):
    data = np.array([3.0, 1.0, 4.0, 1.5, 9.0])
    df = spark.createDataFrame([(i, float(x), 5) for i, x in enumerate(data)], "pos long, v double, n int")
    for mode in ("edge", "reflect", "symmetric", "wrap", "mean", "maximum", "minimum", "median"):
        want = np.pad(data, (3, 4), mode=mode).tolist()
        got = [v for _, v in values(slices.padded_slice(df, "pos", "v", -3, 9, mode=mode, size="n"), "pos", "v")]
        assert got == pytest.approx(want), mode
        if mode != "median":
            row = spark.range(1).select(R.pad(F.array(*map(F.lit, data.tolist())), 3, 4, mode).alias("a")).first()
            assert row.a == pytest.approx(want), mode
    for mode in ("edge", "reflect", "symmetric", "wrap"):
        x = np.arange(6.0).reshape(2, 3)
        assert Tensor.from_numpy(spark, x).pad([(1, 2), (2, 1)], mode=mode).numpy().tolist() == np.pad(x, [(1, 2), (2, 1)], mode=mode).tolist(), mode
    with pytest.raises(ValueError):
        slices.padded_slice(df, "pos", "v", -3, 9, mode="linear_ramp", size="n")
    with pytest.raises(ValueError):
        slices.padded_slice(df, "pos", "v", -3, 9, mode="edge")


def test_tensors_with_absent_cells_differ(spark):
    a = Tensor(spark.createDataFrame([(0, 1.0), (1, 2.0)], "d0 long, v double"), (3,))
    b = Tensor(spark.createDataFrame([(0, 1.0), (2, 2.0)], "d0 long, v double"), (3,))
    nan = Tensor(spark.createDataFrame([(0, float("nan"))], "d0 long, v double"), (1,))
    assert a.array_equal(a) and not a.array_equal(b) and not b.array_equal(a)
    assert not nan.array_equal(nan) and nan.array_equal(nan, equal_nan=True)


def test_products_of_any_rank(spark):
    rng = np.random.default_rng(1)
    for x, y in (((2, 3, 4), (2, 4, 5)), ((2, 3, 4), (4, 5)), ((3, 4), (2, 4, 5)), ((4,), (4, 3)), ((3, 4), (4,)), ((4,), (4,))):
        a, b = rng.integers(0, 9, x).astype(float), rng.integers(0, 9, y).astype(float)
        assert Tensor.from_numpy(spark, a).matmul(Tensor.from_numpy(spark, b)).numpy().tolist() == (a @ b).tolist()


def test_negative_positions(spark):
    f = Frame.make(spark, {"x": [10, 11, 12, 13]})
    assert [r.x for r in f.iloc(-1).collect()] == [13] and f.iloc(-9).count() == 0
    assert sorted(r.x for r in f.iloc(slice(-3, None)).collect()) == [11, 12, 13] and sorted(r.x for r in f.iloc(slice(-9, -2)).collect()) == [10, 11]
    assert values(f.take([-1, 0, -4]).df, "pos", "x") == [(0, 13), (1, 10), (2, 10)]


def test_the_session_seed(spark):
    ids = spark.range(20)
    N.seed_global(spark, "abc")
    try:
        assert ids.select(N.uniform("id")).collect() == ids.select(N.uniform("id", seed=N.ensure_seed("abc"))).collect() != ids.select(N.uniform("id", seed=1)).collect()
        assert ids.select(D.Normal(0, 1).sample("id")).collect() == ids.select(D.Normal(0, 1).sample("id", N.ensure_seed("abc"))).collect()
    finally:
        spark.conf.unset("arrayloom.seed")


def test_sparse_draws(spark):
    items = spark.range(1000).withColumnRenamed("id", "x")
    got = [tuple(r) for r in N.random_combinations(items, "x", 3, 200, seed=5).collect()]
    assert len(set(got)) == 200 and all(a < b < c for a, b, c in got)
    drawn = [tuple(r) for r in N.random_product(spark, [list(range(50))] * 3, 3000, seed=2).collect()]
    assert len(set(drawn)) == 3000 and all(abs(np.mean([d[i] for d in drawn]) - 24.5) < 1 for i in range(3))


def test_normal_quantiles(spark):
    import statistics

    p = [1e-12, 1e-5, 0.02, 0.075, 0.3, 0.5, 0.7, 0.93, 0.999999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(D.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([statistics.NormalDist().inv_cdf(x) for x in p], rel=1e-13, abs=1e-15)


def test_exact_cover_of_many_sets(spark):
    sets = {f"s{i:02}": [i, i + 1, 60] for i in range(50)}
    df = spark.createDataFrame([(s, x) for s, xs in sets.items() for x in xs], "s string, x int")
    found = cover.setcover(df, "s", "x", "exact")
    assert len(found) == 26 and {x for s in found for x in sets[s]} == {x for xs in sets.values() for x in xs}
    best = cover.setcover(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4)], "s string, x int"), "s", "x", "exact", weights={"a": 1, "b": 1, "c": 2}, max_weight=2)
    assert best == ["a", "b"]


def test_types_of_all_kinds():
    assert T.spark_type("uint64") == "decimal(20,0)" and T.dtype_info("uint64")["max"] == 2**64 - 1
    assert T.dtype_kind(T.spark_type("complex64")) == "c" and T.dtype_info("complex128")["bits"] == 128


def test_one_name_for_either_form(spark):
    data = [3.0, 1.0, 2.0]
    t, c = arrays.coerce(spark, data), arrays.coerce(spark, data, like="column")
    assert isinstance(t, Tensor) and arrays.coerce(spark, t) is t
    assert arrays.call("argsort", t).numpy().tolist() == spark.range(1).select(arrays.call("argsort", c).alias("a")).first().a == [1, 2, 0]
    assert float(arrays.call("maximum", t).numpy()) == spark.range(1).select(arrays.call("maximum", c).alias("a")).first().a == 3.0
    with pytest.raises(TypeError):
        arrays.impl(3)
    with pytest.raises(AttributeError):
        arrays.call("nothing", t)


def test_empty_accumulators_raise(spark):
    df = spark.createDataFrame([], "v double")
    with pytest.raises(Exception, match="no data"):
        stats.summary(stats.running(df, "v")).collect()


def test_masks_and_units_of_more_axes(spark):
    at = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "i long, j long")
    got = Tensor(topk.boolmask(at, ["i", "j"], (3, 3)).withColumnRenamed("flag", "v"), (3, 3)).numpy()
    assert got.tolist() == [[True, False, False], [False, True, False], [False, True, False]]
    labels = Tensor.from_numpy(spark, [[0, 2], [1, -1]])
    assert labels.one_hot(3, axis=1).numpy().tolist() == np.moveaxis(np.eye(3)[[[0, 2], [1, 2]]], -1, 1).tolist()


def test_sequences_without_groups(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 5, 6, 7, 8, 9, 10, 15, 99, 100, 101])], "pos long, v int").repartition(3)
    runs = groups.group_consecutive_indices(df, "v", "pos")
    assert values(runs, "first", "last", "n") == [(0, 2, 3), (3, 8, 6), (9, 9, 1), (10, 12, 3)]
    bounds = groups.flat_bounds(spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "o long, n long"), "o", "n")
    assert values(bounds, "o", "start", "stop") == [(0, 0, 1), (1, 1, 1), (2, 1, 4)] and groups.flat_length(bounds).first().n == 4
