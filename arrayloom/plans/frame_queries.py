"""Queries over frames, robust normalisation, slices, windows, stitching and one-hot."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrayloom.functions import elementwise as E  # noqa: N812
from arrayloom.functions import rows as R  # noqa: N812
from arrayloom.operators import robust, slices, slider
from arrayloom.operators.frame import Frame
from arrayloom.plans.registry import query, table
from arrayloom.plans.stats_queries import rounded
from arrayloom.sources import frames as sources


def _nations(spark, sf_dir):
    return Frame(table(spark, sf_dir, "nation").withColumn("pos", F.col("n_nationkey").cast("bigint")))


def _suppliers(spark, sf_dir):
    return Frame(sources.read(spark, f"{sf_dir}/supplier.parquet", ["s_suppkey"]))


_POS = "s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)"


@query("frame_positions", f"WITH {_POS} SELECT pos, s_suppkey FROM s")
def frame_positions(spark, sf_dir):
    return _suppliers(spark, sf_dir)["s_suppkey"]


@query("frame_from_records", "SELECT * FROM (VALUES (0::BIGINT, 'a', 1.5::DOUBLE), (1, 'b', 2.5)) t(pos, name, x)")
def frame_from_records(spark, sf_dir):
    return Frame.from_dict(spark, [{"name": "a", "x": 1.5}, {"name": "b", "x": 2.5}]).df


@query("frame_from_pandas", "SELECT range::BIGINT AS pos, range * 2 AS twice FROM range(0, 7)")
def frame_from_pandas(spark, sf_dir):
    import pandas as pd

    return Frame.from_pandas(spark, pd.DataFrame({"twice": [2 * i for i in range(7)]})).df


@query("frame_getitem", f"WITH {_POS} SELECT pos, s_acctbal FROM s")
def frame_getitem(spark, sf_dir):
    return _suppliers(spark, sf_dir)["s_acctbal"]


@query("frame_get_default", f"WITH {_POS} SELECT pos, 7 AS missing FROM s")
def frame_get_default(spark, sf_dir):
    return _suppliers(spark, sf_dir).get("missing", 7)


@query("frame_getcols", f"WITH {_POS} SELECT pos, round(s_acctbal + 2 * s_nationkey, 4) AS mixed FROM s")
def frame_getcols(spark, sf_dir):
    """Columns as a vector, and a product of it with another one."""
    v = _suppliers(spark, sf_dir).getcols(["s_acctbal", "s_nationkey"])
    return v.select("pos", F.round(R.dot("values", F.array(F.lit(1.0), F.lit(2.0))), 4).alias("mixed"))


@query("frame_setitem", f"WITH {_POS} SELECT pos, s_suppkey, round(s_acctbal * 2, 4) AS s_acctbal FROM s")
def frame_setitem(spark, sf_dir):
    return _suppliers(spark, sf_dir).assign("s_acctbal", F.round(F.col("s_acctbal") * 2, 4)).df.select("pos", "s_suppkey", "s_acctbal")


@query("frame_iloc", f"WITH {_POS} SELECT pos, s_name FROM s WHERE pos >= 3 AND pos < 9 AND (pos - 3) % 2 = 0")
def frame_iloc(spark, sf_dir):
    return _suppliers(spark, sf_dir).iloc(slice(3, 9, 2)).select("pos", "s_name")


@query("frame_iloc_negative", f"WITH {_POS} SELECT pos, s_name FROM s WHERE pos >= (SELECT count(*) FROM s) - 7 AND pos < (SELECT count(*) FROM s) - 2")
def frame_iloc_negative(spark, sf_dir):
    return _suppliers(spark, sf_dir).iloc(slice(-7, -2)).select("pos", "s_name")


@query("frame_take_negative", "SELECT o.pos::BIGINT AS pos, n_name FROM (VALUES (0, 24), (1, 4), (2, 0)) o(pos, place) JOIN nation ON n_nationkey = place")
def frame_take_negative(spark, sf_dir):
    return _nations(spark, sf_dir).take([-1, 4, -25]).df.select("pos", "n_name")


@query("frame_take", "SELECT o.pos::BIGINT AS pos, n_name FROM (VALUES (0, 4), (1, 4), (2, 24), (3, 0)) o(pos, place) JOIN nation ON n_nationkey = place")
def frame_take(spark, sf_dir):
    return _nations(spark, sf_dir).take([4, 4, 24, 0]).df.select("pos", "n_name")


@query("frame_compress", "SELECT n_nationkey::BIGINT AS pos, n_name FROM nation WHERE n_regionkey >= 3")
def frame_compress(spark, sf_dir):
    return _nations(spark, sf_dir).compress(F.col("n_regionkey") >= 3).df.select("pos", "n_name")


@query("frame_compress_mask", "SELECT n_nationkey::BIGINT AS pos, n_name FROM nation WHERE n_nationkey % 3 = 0")
def frame_compress_mask(spark, sf_dir):
    return _nations(spark, sf_dir).compress([i % 3 == 0 for i in range(25)]).df.select("pos", "n_name")


@query("frame_sort_values", "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS pos, n_nationkey FROM nation")
def frame_sort_values(spark, sf_dir):
    return _nations(spark, sf_dir).sort_values("n_regionkey").df.select("pos", "n_nationkey")


@query("frame_sort_descending", "SELECT row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey DESC) - 1 AS pos, n_nationkey FROM nation")
def frame_sort_descending(spark, sf_dir):
    return _nations(spark, sf_dir).sort_values("n_regionkey", ascending=False).df.select("pos", "n_nationkey")


@query("frame_union", "SELECT n_nationkey::BIGINT AS pos, n_nationkey FROM nation UNION ALL SELECT 25 + n_nationkey, n_nationkey FROM nation UNION ALL SELECT 50 + n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 5")
def frame_union(spark, sf_dir):
    n = _nations(spark, sf_dir)
    return Frame.concat([n, n.copy(), Frame(n.iloc(slice(None, 5)))]).df.select("pos", "n_nationkey")


@query("frame_extend", "SELECT n_nationkey::BIGINT AS pos, n_name FROM nation UNION ALL SELECT 25 + r_regionkey, r_name FROM region")
def frame_extend(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("pos"), F.col("r_name").alias("n_name"), F.lit(1).alias("further"))
    return Frame(_nations(spark, sf_dir).df.select("pos", "n_name")).extend(Frame(regions)).df


@query("frame_clear", "SELECT n_regionkey, 0::BIGINT AS n FROM nation GROUP BY 1")
def frame_clear(spark, sf_dir):
    """How many rows of each region a cleared frame has."""
    left = _nations(spark, sf_dir).clear().df.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    regions = table(spark, sf_dir, "nation").select("n_regionkey").distinct()
    return regions.join(left, "n_regionkey", "left").select("n_regionkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("frame_groupby", "SELECT n_regionkey, count(*)::BIGINT AS n, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def frame_groupby(spark, sf_dir):
    out = _nations(spark, sf_dir).groupby("n_regionkey")
    return out.select("n_regionkey", F.size("rows").cast("bigint").alias("n"), F.concat_ws("|", F.transform("rows", lambda r: r["n_name"])).alias("names"))


@query("frame_rename", "SELECT n_nationkey::BIGINT AS pos, n_nationkey AS key, n_name, n_regionkey FROM nation")
def frame_rename(spark, sf_dir):
    return _nations(spark, sf_dir).rename(columns={"n_nationkey": "key", "unknown": "x"}).reset_index().df


@query("frame_equals", "SELECT n_nationkey::BIGINT AS pos, true AS n_name, n_nationkey % 2 = 0 AS n_regionkey FROM nation")
def frame_equals(spark, sf_dir):
    n = Frame(_nations(spark, sf_dir).df.select("pos", "n_name", "n_regionkey"))
    other = n.assign("n_regionkey", F.when(F.col("pos") % 2 == 0, F.col("n_regionkey")).otherwise(-1))
    return n.equals(other)


@query("frame_shape", "SELECT 'supplier' AS name, count(*)::BIGINT AS n, 's_suppkey,s_name,s_nationkey,s_acctbal' AS columns, true AS has_name FROM supplier")
def frame_shape(spark, sf_dir):
    f = _suppliers(spark, sf_dir)
    return f.df.agg(F.count("*").alias("n")).select(F.lit("supplier").alias("name"), "n", F.lit(",".join(f.keys())).alias("columns"), F.lit("s_name" in f).alias("has_name"))


# robust normalisation


@query(
    "normalize_linear",
    "WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS normalized FROM part, m",
)
def normalize_linear(spark, sf_dir):
    return rounded(robust.normalize(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", "normalized"), ["normalized"])


@query(
    "normalize_sigmoid",
    """WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), a AS (SELECT lo, hi, hi - lo AS beta, greatest(abs(lo - (hi - lo)), abs(hi - (hi - lo))) / 6.212606095751518 AS alpha FROM m)
    SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal - beta) / alpha)), 6) AS normalized FROM customer, a""",
)
def normalize_sigmoid(spark, sf_dir):
    return rounded(robust.normalize(table(spark, sf_dir, "customer"), "c_acctbal", "sigmoid").select("c_custkey", "normalized"), ["normalized"])


@query(
    "normalize_whole",
    "WITH m AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT p_partkey, trunc((p_size - lo)::DOUBLE * (255.0::DOUBLE / (hi - lo)))::SMALLINT AS normalized FROM part, m",
)
def normalize_whole(spark, sf_dir):
    """Whole numbers scaled to the range of an unsigned byte and cut."""
    return robust.normalize(table(spark, sf_dir, "part"), "p_size", top=255.0, whole="smallint").select("p_partkey", "normalized")


@query("normalize_parameters", "SELECT p_partkey, round(1 / (1 + exp(-(least(greatest(p_retailprice, 950.0::DOUBLE), 1500.0::DOUBLE) - 1200) / 80)), 6) AS normalized FROM part")
def normalize_parameters(spark, sf_dir):
    """A sigmoid whose ends, centre and scale are given."""
    out = robust.normalize(table(spark, sf_dir, "part"), "p_retailprice", "sigmoid", alpha=80, beta=1200, min_val=950, max_val=1500)
    return rounded(out.select("p_partkey", "normalized"), ["normalized"])


_Q = "q AS (SELECT o_orderpriority, min(o_totalprice) AS q0, quantile_cont(o_totalprice, {a}) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, {b}) AS b, max(o_totalprice) AS q1 FROM orders GROUP BY 1)"


def _fence(low, high, a, b):
    return f"""WITH {_Q.format(a=a, b=b)}, f AS (SELECT o_orderpriority, {low} AS lo, {high} AS hi, m FROM q) SELECT o_orderpriority, round(lo, 4) AS min_val, round(m, 4) AS mid_val, round(hi, 4) AS max_val, round(m, 4) AS beta,
    round(greatest(abs(lo - m), abs(hi - m)) / 6.212606095751518, 4) AS alpha FROM f"""


def _normalizers(spark, sf_dir, params, **more):
    out = robust.find_robust_normalizers(table(spark, sf_dir, "orders"), "o_totalprice", params, ["o_orderpriority"], **more)
    return rounded(out, ["min_val", "mid_val", "max_val", "beta", "alpha"], 4)


@query("robust_tukey", _fence("a - 1.5 * (b - a)", "a + 1.5 * (b - a)", 0.25, 0.75))
def robust_tukey(spark, sf_dir):
    return _normalizers(spark, sf_dir, "tukey")


@query("robust_tukey_textbook", _fence("greatest(a - 1.5 * (b - a), q0)", "least(b + 1.5 * (b - a), q1)", 0.25, 0.75))
def robust_tukey_textbook(spark, sf_dir):
    return _normalizers(spark, sf_dir, {"extrema": "tukey-clip"}, textbook=True)


@query("robust_quantile", _fence("a", "b", 0.05, 0.95))
def robust_quantile(spark, sf_dir):
    return _normalizers(spark, sf_dir, {"extrema": "quantile", "low": 0.05, "high": 0.95})


@query("robust_adaptive", _fence("greatest(q0, a - 0.01 * (m - a))", "q1", 0.01, 0.9))
def robust_adaptive(spark, sf_dir):
    return _normalizers(spark, sf_dir, "auto")


_APPLY = """WITH v AS (SELECT *, event_type <> 'purchase' OR user_id % 3 > 0 AS ok FROM events), q AS (SELECT {g} min(value) AS q0, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.5) AS m, max(value) AS hi FROM v WHERE ok {gb}),
    f AS (SELECT *, greatest(q0, a - 0.01 * (m - a)) AS lo FROM q) SELECT event_id, round(CASE WHEN ok THEN (least(greatest(value, lo), hi) - lo) / (hi - lo) ELSE value END, 6) AS normalized FROM v {j}"""


def _applied(spark, sf_dir, by):
    valid = (F.col("event_type") != "purchase") | (F.col("user_id") % 3 > 0)
    return rounded(robust.robust_normalize(table(spark, sf_dir, "events"), "value", by=by, valid=valid).select("event_id", "normalized"), ["normalized"])


@query("robust_normalize", _APPLY.format(g="", gb="", j=", f"))
def robust_normalize(spark, sf_dir):
    """Fences from valid rows; the others stay as they are."""
    return _applied(spark, sf_dir, None)


@query("robust_normalize_axis", _APPLY.format(g="event_type,", gb="GROUP BY event_type", j="JOIN f USING (event_type)"))
def robust_normalize_axis(spark, sf_dir):
    return _applied(spark, sf_dir, ["event_type"])


@query(
    "robust_normalize_sigmoid",
    """WITH q AS (SELECT min(value) AS q0, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.5) AS m, max(value) AS hi FROM events), f AS (SELECT *, greatest(q0, a - 0.01 * (m - a)) AS lo FROM q),
    g AS (SELECT *, greatest(abs(lo - m), abs(hi - m)) / 6.212606095751518 AS alpha FROM f) SELECT event_id, round(1 / (1 + exp(-(least(greatest(value, lo), hi) - m) / alpha)), 6) AS normalized FROM events, g""",
)
def robust_normalize_sigmoid(spark, sf_dir):
    return rounded(robust.robust_normalize(table(spark, sf_dir, "events"), "value", "sigmoid").select("event_id", "normalized"), ["normalized"])


@query("generalized_logistic", "SELECT p_partkey, round(0.5 + 2.5 / pow(1 + 0.5 * exp(-0.1 * p_size), 0.5), 6) AS y FROM part")
def generalized_logistic(spark, sf_dir):
    y = E.generalized_logistic("p_size", floor=0.5, capacity=3.0, Q=0.5, growth=0.1, v=2)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(y, 6).alias("y"))


@query("isect_flags", "SELECT p_partkey, p_size IN (1, 4, 6, 17) AS flag FROM part")
def isect_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", E.isect_flags("p_size", [1, 4, 6, 17]).alias("flag"))


_NAN = "e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE ELSE (event_id % 3)::DOUBLE END AS a, CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE ELSE (event_id % 2)::DOUBLE END AS b FROM events)"


def _nans(spark, sf_dir):
    pick = lambda k, m: F.when(F.col("event_id") % k == 0, float("nan")).otherwise((F.col("event_id") % m).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", pick(5, 3).alias("a"), pick(10, 2).alias("b"))


@query("equal_with_nan", f"WITH {_NAN} SELECT event_id, a = b AS same, (a = b AND NOT isnan(a)) <> (isnan(a) = isnan(b)) AS literal_same FROM e")
def equal_with_nan(spark, sf_dir):
    return _nans(spark, sf_dir).select("event_id", E.equal_with_nan("a", "b").alias("same"), E.equal_with_nan("a", "b", literal=True).alias("literal_same"))


# windows, slices, one-hot


@query(
    "slide_windows",
    "SELECT (i * 5 + j)::BIGINT AS flat, i::BIGINT AS g0, j::BIGINT AS g1, (i * 2)::BIGINT AS start0, (i * 2 + 4)::BIGINT AS stop0, i * 2 + 1.5::DOUBLE AS center0, (j * 3)::BIGINT AS start1, (j * 3 + 4)::BIGINT AS stop1, j * 3 + 1.5::DOUBLE AS center1 FROM range(0, 7) a(i), range(0, 5) b(j)",
)
def slide_windows(spark, sf_dir):
    return slider.SlidingWindow((16, 16), (4, 4), overlap=(0.5, 0.25)).frame(spark)


@query("slide_windows_keepbound", "SELECT i::BIGINT AS flat, i::BIGINT AS g0, least(i * 3, 6)::BIGINT AS start0, (least(i * 3, 6) + 4)::BIGINT AS stop0, least(i * 3, 6) + 1.5::DOUBLE AS center0 FROM range(0, 3) a(i)")
def slide_windows_keepbound(spark, sf_dir):
    return slider.SlidingWindow((10,), (4,), stride=3, keepbound=True, allow_overshoot=True).frame(spark)


_HOURS = "h AS (SELECT event_id % 48 AS d0, value, user_id % 4 AS w FROM events)"


@query(
    "stitch_weighted",
    f"""WITH {_HOURS}, p AS (SELECT g * 4 AS start, avg(value) AS x FROM h, range(0, 11) r(g) WHERE d0 >= g * 4 AND d0 < g * 4 + 8 GROUP BY 1)
    SELECT c.range AS d0, round(sum((start + 1) * x) / sum(start + 1), 6) AS v FROM range(0, 48) c JOIN p ON c.range >= start AND c.range < start + 8 GROUP BY 1""",
)
def stitch_weighted(spark, sf_dir):
    """Slide over hours, average each window, and put the windows' averages together again, weighted by their start."""
    window = slider.SlidingWindow((48,), (8,), stride=4)
    cells = table(spark, sf_dir, "events").select((F.col("event_id") % 48).alias("d0"), "value")
    means = window.cover(cells, ["d0"]).groupBy("start0").agg(F.avg("value").alias("x"))
    patches = means.select("x", (F.col("start0") + 1).alias("w"), F.explode(F.sequence(F.col("start0"), F.col("start0") + 7)).alias("d0"))
    return rounded(slider.stitch(patches, ["d0"], "x", "w"), ["v"])


_PATCH = "p AS (SELECT event_id % 10 AS d0, CASE WHEN event_id % 3 = 0 OR event_id % 10 = 4 THEN 'nan'::DOUBLE ELSE value END AS x FROM events)"


def _patches(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 10).alias("d0"), F.when((F.col("event_id") % 3 == 0) | (F.col("event_id") % 10 == 4), float("nan")).otherwise(F.col("value")).alias("v"))


@query("stitch_nan_omit", f"WITH {_PATCH}, s AS (SELECT d0, avg(x) FILTER (NOT isnan(x)) AS v FROM p GROUP BY 1) SELECT r.range AS d0, round(coalesce(v, 'nan'::DOUBLE), 6) AS v FROM range(0, 11) r LEFT JOIN s ON d0 = r.range")
def stitch_nan_omit(spark, sf_dir):
    """NaN counts for nothing; cells that no number covers are NaN."""
    return rounded(slider.stitch_grid(_patches(spark, sf_dir), (11,)), ["v"])


@query("stitch_placed", "WITH p AS (SELECT o.range * 7 + n_nationkey AS d0, n_nationkey * n_regionkey * 1.0::DOUBLE AS v FROM nation, range(0, 4) o) SELECT d0 - 5 AS d0, round(avg(v), 6) AS v FROM p WHERE d0 >= 5 AND d0 < 40 GROUP BY 1")
def stitch_placed(spark, sf_dir):
    """One patch added at four places; a region of the average."""
    from functools import reduce

    patch = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("d0"), (F.col("n_nationkey") * F.col("n_regionkey")).cast("double").alias("v"))
    patches = reduce(lambda a, b: a.unionByName(b), [slider.placed(patch, ["d0"], [7 * k]) for k in range(4)])
    return rounded(slider.region(slider.stitch(patches, ["d0"]), ["d0"], [(5, 40)]), ["v"])


@query("stitch_nan_propagate", f"WITH {_PATCH} SELECT d0, round(CASE WHEN bool_or(isnan(x)) THEN 'nan'::DOUBLE ELSE avg(x) END, 6) AS v FROM p GROUP BY 1")
def stitch_nan_propagate(spark, sf_dir):
    return rounded(slider.stitch(_patches(spark, sf_dir), ["d0"], nan_policy="propagate"), ["v"])


@query(
    "padded_slice",
    """WITH c AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, c_custkey FROM customer), g AS (SELECT DISTINCT c_mktsegment FROM customer)
    SELECT c_mktsegment, r.range + 3 AS pos, coalesce(c_custkey, -1) AS c_custkey FROM g CROSS JOIN range(-3, 6) r LEFT JOIN c USING (c_mktsegment) WHERE r.range < 0 OR i = r.range UNION ALL
    SELECT c_mktsegment, r.range + 3, -1 FROM g CROSS JOIN range(0, 6) r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.c_mktsegment = g.c_mktsegment AND c.i = r.range)""".replace("LEFT JOIN c USING (c_mktsegment) WHERE r.range < 0 OR i = r.range", "JOIN c USING (c_mktsegment) WHERE i = r.range UNION ALL SELECT c_mktsegment, r.range + 3, -1 FROM g CROSS JOIN range(-3, 0) r"),
)
def padded_slice(spark, sf_dir):
    from pyspark.sql import Window

    numbered = table(spark, sf_dir, "customer").withColumn("pos", (F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1).cast("bigint"))
    return slices.padded_slice(numbered, "pos", "c_custkey", -2, 5, (1, 1), ["c_mktsegment"], fill=-1)


_WHERE = {
    "edge": "CASE WHEN p < 0 THEN 0 WHEN p >= n THEN n - 1 ELSE p END",
    "reflect": "CASE WHEN n = 1 THEN 0 WHEN (p % (2 * n - 2) + 2 * n - 2) % (2 * n - 2) < n THEN (p % (2 * n - 2) + 2 * n - 2) % (2 * n - 2) ELSE 2 * n - 2 - (p % (2 * n - 2) + 2 * n - 2) % (2 * n - 2) END",
    "symmetric": "CASE WHEN (p % (2 * n) + 2 * n) % (2 * n) < n THEN (p % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - (p % (2 * n) + 2 * n) % (2 * n) END",
    "wrap": "(p % n + n) % n",
}


def _padded(mode):
    """A slice of each nation's customers that reaches beyond both ends (places -3 to 99), padded by a mode of places."""

    @query(
        f"padded_slice_{mode}",
        f"""WITH c AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_custkey FROM customer), g AS (SELECT c_nationkey, least(count(*), 100) AS n FROM customer GROUP BY 1),
        p AS (SELECT c_nationkey, n, r.range AS p FROM g CROSS JOIN range(-3, 100) r) SELECT c_nationkey, p + 3 AS pos, c_custkey FROM (SELECT *, {_WHERE[mode]} AS i FROM p) JOIN c USING (c_nationkey, i)""",
    )
    def run(spark, sf_dir):
        from pyspark.sql import Window

        w = Window.partitionBy("c_nationkey")
        numbered = table(spark, sf_dir, "customer").withColumns({"pos": (F.row_number().over(w.orderBy("c_custkey")) - 1).cast("bigint"), "size": F.count("*").over(w)})
        return slices.padded_slice(numbered, "pos", "c_custkey", -2, 99, (1, 1), ["c_nationkey"], mode=mode, size="size")


for _mode in _WHERE:
    _padded(_mode)


@query("padded_slice_mean", """WITH c AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_acctbal FROM customer), m AS (SELECT c_nationkey, avg(c_acctbal) AS mean FROM c WHERE i < 5 GROUP BY 1)
    SELECT c_nationkey, r.range + 2 AS pos, round(coalesce((SELECT c_acctbal FROM c WHERE c.c_nationkey = m.c_nationkey AND c.i = r.range), mean), 6) AS c_acctbal FROM m CROSS JOIN range(-2, 5) r""")
def padded_slice_mean(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey")
    numbered = table(spark, sf_dir, "customer").withColumns({"pos": (F.row_number().over(w.orderBy("c_custkey")) - 1).cast("bigint"), "size": F.count("*").over(w)})
    return rounded(slices.padded_slice(numbered, "pos", "c_acctbal", -2, 5, (0, 0), ["c_nationkey"], mode="mean", size="size"), ["c_acctbal"])


@query(
    "embed_slice",
    """WITH s AS (SELECT n_nationkey, n_nationkey - 8 AS lo, n_nationkey * 2 AS hi, 20 AS n FROM nation) SELECT n_nationkey, least(greatest(lo, 0), n) AS start, greatest(least(hi, n), 0, least(greatest(lo, 0), n)) AS stop,
    greatest(0, least(hi, 0) - lo) AS before, greatest(0, hi - greatest(lo, n)) AS after FROM s""",
)
def embed_slice(spark, sf_dir):
    key = F.col("n_nationkey")
    start, stop, before, after = slices.embed_columns(key - 8, key * 2, F.lit(20))
    return table(spark, sf_dir, "nation").select("n_nationkey", start.alias("start"), stop.alias("stop"), before.alias("before"), after.alias("after"))


@query("one_hot", "SELECT doc_id, r.range::INTEGER AS class, CASE WHEN quality * 2 + toxic = r.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM labels, range(0, 4) r")
def one_hot(spark, sf_dir):
    label = table(spark, sf_dir, "labels")
    return label.select("doc_id", F.posexplode(R.one_hot(F.col("quality") * 2 + F.col("toxic"), 4)).alias("class", "v"))


@query("one_hot_lookup", "SELECT vec_id, embedding[label + 1] AS v FROM embeddings")
def one_hot_lookup(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", R.one_hot_lookup("embedding", "label").alias("v"))
