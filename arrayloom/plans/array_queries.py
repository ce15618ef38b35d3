"""Queries over tensors and array columns; the embeddings are a matrix with a row per vec_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrayloom.functions import elementwise as E  # noqa: N812
from arrayloom.functions import rows as R  # noqa: N812
from arrayloom.operators import tensor as T  # noqa: N812
from arrayloom.operators.tensor import Tensor
from arrayloom.plans.registry import query, table
from arrayloom.plans.stats_queries import rounded

_E = "e AS (SELECT vec_id AS d0, unnest(range(len(embedding))) AS d1, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_N = "n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _matrix(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return Tensor.from_rows(df, "vec_id", "v", (df.agg(F.max("vec_id")).first()[0] + 1, 64))


def _out(t, digits=6):
    return t.df.withColumn("v", F.round("v", digits))


@query("arr_sum_axis0", f"WITH {_E} SELECT d1 AS d0, round(sum(v), 4) AS v FROM e GROUP BY 1")
def arr_sum_axis0(spark, sf_dir):
    return _out(_matrix(spark, sf_dir).sum(0), 4)


@query("arr_sum_all", f"WITH {_E} SELECT round(sum(v), 3) AS v FROM e")
def arr_sum_all(spark, sf_dir):
    return _out(_matrix(spark, sf_dir).sum(), 3)


@query("arr_max_axis1", f"WITH {_E} SELECT d0, max(v) AS v FROM e GROUP BY 1")
def arr_max_axis1(spark, sf_dir):
    return _matrix(spark, sf_dir).max(1).df


@query("arr_min_axis0", f"WITH {_E}, n AS (SELECT d0, d1, CASE WHEN d0 = 3 AND d1 % 2 = 0 THEN 'nan'::DOUBLE ELSE v END AS v FROM e) SELECT d1 AS d0, CASE WHEN bool_or(isnan(v)) THEN 'nan'::DOUBLE ELSE min(v) END AS v FROM n GROUP BY 1")
def arr_min_axis0(spark, sf_dir):
    """NaN propagates."""
    m = _matrix(spark, sf_dir)
    return Tensor(m.df.withColumn("v", F.when((F.col("d0") == 3) & (F.col("d1") % 2 == 0), float("nan")).otherwise(F.col("v"))), m.shape).min(0).df


@query("arr_argmax_axis1", f"WITH {_E} SELECT d0, (SELECT NULL) IS NULL AS ok, v FROM (SELECT d0, d1 AS v, row_number() OVER (PARTITION BY d0 ORDER BY e.v DESC, d1) AS r FROM e) WHERE r = 1")
def arr_argmax_axis1(spark, sf_dir):
    return _matrix(spark, sf_dir).argmax(1).df.withColumn("ok", F.lit(True))


@query("arr_argmin_all", f"WITH {_E} SELECT d0 * 64 + d1 AS v FROM e ORDER BY e.v, d0, d1 LIMIT 1")
def arr_argmin_all(spark, sf_dir):
    return _matrix(spark, sf_dir).argmin().df


@query("arr_max_argmax", f"WITH {_E} SELECT d0, max(v) AS v, arg_max(d1, v) AS place FROM e GROUP BY 1")
def arr_max_argmax(spark, sf_dir):
    top, at = _matrix(spark, sf_dir).max_argmax(1)
    return top.df.join(at.df.withColumnRenamed("v", "place"), "d0")


@query("arr_min_argmin", f"WITH {_E} SELECT d1 AS d0, min(v) AS v, arg_min(d0, v) AS place FROM e GROUP BY e.d1")
def arr_min_argmin(spark, sf_dir):
    low, at = _matrix(spark, sf_dir).min_argmin(0)
    return low.df.join(at.df.withColumnRenamed("v", "place"), "d0")


@query("arr_argsort", f"WITH {_E} SELECT d0, row_number() OVER (PARTITION BY d0 ORDER BY e.v, e.d1) - 1 AS d1, d1 AS v FROM e")
def arr_argsort(spark, sf_dir):
    return _matrix(spark, sf_dir).argsort(1).df


@query("arr_argsort_descending", f"WITH {_E} SELECT row_number() OVER (PARTITION BY e.d1 ORDER BY e.v DESC, e.d0 DESC) - 1 AS d0, d1, d0 AS v FROM e")
def arr_argsort_descending(spark, sf_dir):
    return _matrix(spark, sf_dir).argsort(0, descending=True).df


@query("arr_transpose", f"WITH {_E} SELECT d1 AS d0, d0 AS d1, v FROM e")
def arr_transpose(spark, sf_dir):
    return _matrix(spark, sf_dir).T.df


@query("arr_view", f"WITH {_E} SELECT (e.d0 * 64 + e.d1) // 32 AS d0, (e.d0 * 64 + e.d1) // 4 % 8 AS d1, (e.d0 * 64 + e.d1) % 4 AS d2, v FROM e")
def arr_view(spark, sf_dir):
    return _matrix(spark, sf_dir).view(-1, 8, 4).df


@query("arr_take", f"WITH {_E}, i AS (SELECT * FROM (VALUES (0, 4), (1, 0), (2, 63)) t(k, i)) SELECT d0, k::BIGINT AS d1, v FROM e JOIN i ON e.d1 = i")
def arr_take(spark, sf_dir):
    return _matrix(spark, sf_dir).take([4, 0, -1], 1).df


@query("arr_compress", f"WITH {_E} SELECT d0, e.d1 // 2 AS d1, v FROM e WHERE e.d1 % 2 = 0")
def arr_compress(spark, sf_dir):
    return _matrix(spark, sf_dir).compress([True, False] * 32, 1).df


@query("arr_repeat", f"WITH {_E} SELECT d0, e.d1 * 3 + r.range AS d1, v FROM e, range(0, 3) r")
def arr_repeat(spark, sf_dir):
    return _matrix(spark, sf_dir).repeat(3, 1).df


@query("arr_tile", f"WITH {_E}, {_N} SELECT e.d0 + n * a.range AS d0, e.d1 + 64 * b.range AS d1, v FROM e, n, range(0, 2) a, range(0, 3) b")
def arr_tile(spark, sf_dir):
    return _matrix(spark, sf_dir).tile((2, 3)).df


@query("arr_cat", f"WITH {_E} SELECT d0, d1, v FROM e UNION ALL SELECT d0, d1 + 64, v * 2 FROM e")
def arr_cat(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return T.cat([m, m.map(lambda v: v * 2)]).df


@query("arr_hstack", f"WITH {_E} SELECT d0, d1, v FROM e UNION ALL SELECT d0, d1 + 64, v FROM e")
def arr_hstack(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return T.hstack([m, m]).df


@query("arr_vstack", f"WITH {_E}, {_N} SELECT d0, d1, v FROM e UNION ALL SELECT n, d1, v FROM e, n WHERE d0 = 0")
def arr_vstack(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return T.vstack([m, Tensor(m.df.where("d0 = 0").select(F.col("d1").alias("d0"), "v"), (64,))]).df


@query("arr_pad", f"WITH {_E}, {_N}, a AS (SELECT unnest(range(n + 2)) AS range FROM n) SELECT a.range AS d0, b.range AS d1, coalesce(v, 9.0) AS v FROM a CROSS JOIN range(0, 67) b LEFT JOIN e ON e.d0 = a.range - 1 AND e.d1 = b.range - 3")
def arr_pad(spark, sf_dir):
    return _matrix(spark, sf_dir).pad([(1, 1), (3, 0)], 9.0).df


@query("arr_atleast_nd", f"WITH {_E} SELECT 0::BIGINT AS d0, e.d0 AS d1, e.d1 AS d2, v FROM e")
def arr_atleast_nd(spark, sf_dir):
    return _matrix(spark, sf_dir).atleast_nd(3, front=True).df


@query("arr_full", "SELECT a.range AS d0, b.range AS d1, 2.5::DOUBLE AS v FROM range(0, 4) a, range(0, 7) b")
def arr_full(spark, sf_dir):
    return Tensor.full(spark, (4, 7), 2.5).df


@query("arr_full_like", f"WITH {_E} SELECT d0, d1, 1.0::DOUBLE AS v, 0.0::DOUBLE AS zero FROM e")
def arr_full_like(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return m.ones_like().df.join(m.zeros_like().df.withColumnRenamed("v", "zero"), m.dims)


@query("arr_matmul", f"WITH {_E}, g AS (SELECT a.d1 AS i, b.d1 AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.d0 = b.d0 GROUP BY 1, 2) SELECT e.d0 AS d0, g.j AS d1, round(sum(e.v * g.v), 4) AS v FROM e JOIN g ON e.d1 = g.i GROUP BY 1, 2")
def arr_matmul(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _out(m.matmul(m.T.matmul(m)), 4)


@query("matmul_gram", f"WITH {_E} SELECT a.d1 AS d0, b.d1 AS d1, round(sum(a.v * b.v), 7) AS v FROM e a JOIN e b ON a.d0 = b.d0 GROUP BY 1, 2")
def matmul_gram(spark, sf_dir):
    """The 64 x 64 product of the transposed matrix with itself."""
    m = _matrix(spark, sf_dir)
    return _out(m.T.matmul(m), 7)


@query("arr_kron", f"WITH {_E}, t AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 1, -2.0), (0, 2, 0.5), (1, 0, 3.0), (1, 1, 0.25), (1, 2, 4.0)) t(d0, d1, w)) SELECT (e.d0 * 2 + t.d0)::BIGINT AS d0, (e.d1 * 3 + t.d1)::BIGINT AS d1, round(v * w::DOUBLE, 6) AS v FROM e, t")
def arr_kron(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _out(m.kron(Tensor.from_numpy(spark, [[1.0, -2.0, 0.5], [3.0, 0.25, 4.0]])))


@query("softmax_rows", f"WITH {_E}, x AS (SELECT d0, d1, exp(v - max(v) OVER (PARTITION BY d0)) AS x FROM e) SELECT d0, d1, round(x / sum(x) OVER (PARTITION BY d0), 6) AS v FROM x")
def softmax_rows(spark, sf_dir):
    return _out(_matrix(spark, sf_dir).softmax(1))


@query("arr_softmax_all", f"WITH {_E}, x AS (SELECT d0, d1, exp(v - max(v) OVER ()) AS x FROM e) SELECT d0, d1, round(x / sum(x) OVER (), 6) AS v FROM x")
def arr_softmax_all(spark, sf_dir):
    return _out(_matrix(spark, sf_dir).softmax())


@query("arr_nonzero", f"WITH {_E} SELECT d0, d1 FROM e WHERE v <> 0 AND v > 0.3")
def arr_nonzero(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return m.map(lambda v: F.when(v > 0.3, v).otherwise(0.0)).nonzero()


@query("arr_any_all", f"WITH {_E} SELECT d0, bool_or(v > 0.3) AS some, bool_and(v > -0.4) AS every FROM e GROUP BY 1")
def arr_any_all(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    flag = lambda t: m.map(lambda v: F.when(t(v), 1.0).otherwise(0.0))
    some, every = flag(lambda v: v > 0.3).any(1), flag(lambda v: v > -0.4).all(1)
    return some.df.withColumnRenamed("v", "some").join(every.df.withColumnRenamed("v", "every"), "d0")


@query("arr_isclose", f"WITH {_E} SELECT d0, d1, abs(v - v * (1 + d1 * 1e-6)) <= 1e-8 + 1e-5 * abs(v * (1 + d1 * 1e-6)) AS v FROM e")
def arr_isclose(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    other = Tensor(m.df.withColumn("v", F.col("v") * (1 + F.col("d1") * F.lit(1e-6))), m.shape)
    return m.isclose(other).df


@query("arr_equal", f"WITH {_E} SELECT bool_and(v = v) AS same, bool_and(v = v + 1e-9::DOUBLE) AS other, bool_and(abs(v - (v + 1e-9)) <= 1e-8 + 1e-5 * abs(v + 1e-9)) AS near, count(*) FILTER (d1 < 63) = count(*) AS fewer FROM e")
def arr_equal(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    more = m.map(lambda v: v + 1e-9)
    fewer = Tensor(m.df.where("d1 < 63"), m.shape)  # cells that only one of them has
    return spark.createDataFrame([(m.array_equal(m), m.array_equal(more), m.allclose(more), m.array_equal(fewer))], "same boolean, other boolean, near boolean, fewer boolean")


@query("arr_maximum_minimum", f"WITH {_E} SELECT d0, d1, greatest(v, -v) AS high, least(v, -v) AS low FROM e")
def arr_maximum_minimum(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    high, low = m.with_other(m.map(lambda v: -v), E.maximum), m.with_other(m.map(lambda v: -v), E.minimum)
    return high.df.withColumnRenamed("v", "high").join(low.df.withColumnRenamed("v", "low"), m.dims)


@query("arr_numel", "SELECT count(*) * 64 AS n, 2::BIGINT AS ndim FROM embeddings")
def arr_numel(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return spark.createDataFrame([(m.numel(), m.ndim)], "n bigint, ndim bigint")


@query(
    "elementwise_logs",
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 11 = 1 THEN -1.0 ELSE value END AS x FROM events)
    SELECT event_id, round(CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS ln, round(CASE WHEN x > 0 THEN log2(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS log2 FROM x""",
)
def elementwise_logs(spark, sf_dir):
    """The logarithm of 0 is -inf, of a negative number NaN."""
    k = F.col("event_id") % 11
    x = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, 0.0).when(k == 1, -1.0).otherwise(F.col("value")).alias("x"))
    keep = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.round(F.when(F.abs(c) < float("inf"), c), 6))
    return x.select("event_id", keep(E.log("x")).alias("ln"), keep(E.log2("x")).alias("log2"))


@query("elementwise_rounding", "SELECT event_id, floor(value) AS floor, ceil(value) AS ceil, floor(value)::INTEGER AS ifloor, ceil(value)::INTEGER AS iceil, round_even(event_id / 2.0, 0) AS round, round_even(event_id / 2.0, 0)::BIGINT AS iround, least(greatest(value, 10.0), 50.0) AS clip, trunc(value)::BIGINT AS whole FROM events")
def elementwise_rounding(spark, sf_dir):
    e, half = table(spark, sf_dir, "events"), F.col("event_id") / 2
    return e.select("event_id", E.floor("value").alias("floor"), E.ceil("value").alias("ceil"), E.ifloor("value").alias("ifloor"), E.iceil("value").alias("iceil"), E.round_even(half).alias("round"), E.iround(half).alias("iround"), E.clip("value", 10.0, 50.0).alias("clip"), E.astype("value", "bigint").alias("whole"))


@query("elementwise_nan_to_num", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.7976931348623157e308 WHEN 2 THEN -1.7976931348623157e308 ELSE value END AS v FROM events")
def elementwise_nan_to_num(spark, sf_dir):
    k = F.col("event_id") % 4
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", E.nan_to_num(x).alias("v"))


_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query("row_reductions", f"WITH {_V} SELECT vec_id, round(list_sum(v), 4) AS sum, list_max(v) AS max, list_min(v) AS min, (list_position(v, list_max(v)) - 1)::INTEGER AS argmax, (list_position(v, list_min(v)) - 1)::INTEGER AS argmin, len(v)::BIGINT AS n FROM v")
def row_reductions(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.round(R.total("v"), 4).alias("sum"), R.maximum("v").alias("max"), R.minimum("v").alias("min"), R.argmax("v").alias("argmax"), R.argmin("v").alias("argmin"), R.numel("v").alias("n"))


@query("row_argmaxima", "SELECT vec_id, string_agg(d1::VARCHAR, ',' ORDER BY v DESC, d1) AS top FROM (SELECT vec_id, unnest(range(64)) AS d1, unnest(embedding) AS v FROM embeddings) QUALIFY true GROUP BY vec_id".replace(" QUALIFY true GROUP BY vec_id", " t WHERE (SELECT count(*) FROM (SELECT unnest(range(64)) AS j, unnest(embedding) AS w FROM embeddings x WHERE x.vec_id = t.vec_id) o WHERE o.w > t.v OR (o.w = t.v AND o.j < t.d1)) < 4 GROUP BY vec_id"))
def row_argmaxima(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.concat_ws(",", F.transform(R.argmaxima("v", 4), lambda i: i.cast("string"))).alias("top"))


@query("row_argsort", "SELECT vec_id, string_agg(d1::VARCHAR, ',' ORDER BY v, d1) AS places FROM (SELECT vec_id, unnest(range(64)) AS d1, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id")
def row_argsort(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.concat_ws(",", F.transform(R.argsort("v"), lambda i: i.cast("string"))).alias("places"))


@query("row_softmax", f"WITH {_E}, x AS (SELECT d0, d1, exp(v - max(v) OVER (PARTITION BY d0)) AS x FROM e) SELECT d0 AS vec_id, d1::INTEGER AS d1, round(x / sum(x) OVER (PARTITION BY d0), 6) AS v FROM x")
def row_softmax(spark, sf_dir):
    return rounded(_vectors(spark, sf_dir).select("vec_id", F.posexplode(R.softmax("v")).alias("d1", "v")), ["v"])


_HEAD = "h AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _explained(df, column):
    return df.select("vec_id", F.posexplode(column).alias("d1", "v"))


@query("row_take_repeat_tile", f"WITH {_HEAD}, o AS (SELECT vec_id, list_concat([v[3], v[1]], flatten(list_transform(v, lambda x: [x, x])), v, v) AS v FROM h) SELECT vec_id, unnest(range(len(v)))::INTEGER AS d1, unnest(v) AS v FROM o")
def row_take_repeat_tile(spark, sf_dir):
    return _explained(_vectors(spark, sf_dir), R.cat(R.take("v", [2, 0]), R.repeat("v", 2), R.tile("v", 2)))


@query("row_compress_nonzero", f"WITH {_HEAD}, o AS (SELECT vec_id, list_filter(v, lambda x: x > 0) AS v FROM h) SELECT vec_id, unnest(range(len(v)))::INTEGER AS d1, unnest(v) AS v FROM o")
def row_compress_nonzero(spark, sf_dir):
    return _explained(_vectors(spark, sf_dir), R.compress("v", F.transform("v", lambda x: x > 0)))


@query("row_pad", f"WITH {_HEAD}, o AS (SELECT vec_id, list_concat([0.0, 0.0], v, [0.0], [v[1], v[1]], v, [v[64]], [v[3], v[2]], v, [v[63]], [v[63], v[64]], v, [v[1]], [v[2], v[1]], v, [v[64]], [list_max(v)], v, [list_max(v)]) AS v FROM h) SELECT vec_id, unnest(range(len(v)))::INTEGER AS d1, unnest(v) AS v FROM o")
def row_pad(spark, sf_dir):
    """Constant, edge, reflect, wrap, symmetric and maximum."""
    return _explained(_vectors(spark, sf_dir), R.cat(R.pad("v", 2, 1, value=0.0), R.pad("v", 2, 1, "edge"), R.pad("v", 2, 1, "reflect"), R.pad("v", 2, 1, "wrap"), R.pad("v", 2, 1, "symmetric"), R.pad("v", 1, 1, "maximum")))


@query("row_padded_slice", f"WITH {_HEAD}, o AS (SELECT vec_id, list_concat([0.0, 0.0], v, [0.0, 0.0, 0.0], v[2:3], [v[3], v[2]], v[1:5]) AS v FROM h) SELECT vec_id, unnest(range(len(v)))::INTEGER AS d1, unnest(v) AS v FROM o")
def row_padded_slice(spark, sf_dir):
    return _explained(_vectors(spark, sf_dir), R.cat(R.padded_slice("v", -2, 67, value=0.0), R.padded_slice("v", 1, 3, value=0.0), R.padded_slice("v", -2, 5, mode="reflect")))


@query("row_distances", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))), 5) AS euclid, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 4) AS city FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def row_distances(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    origin = F.broadcast(v.where("vec_id = 0").select(F.col("v").alias("o")))  # one row
    return v.join(origin).select("vec_id", F.round(R.minkowski("v", "o"), 5).alias("euclid"), F.round(R.minkowski("v", "o", 1), 4).alias("city"))


@query("row_isect_boolmask", "SELECT n_nationkey, r.range::INTEGER AS i, r.range IN (n_nationkey % 7, n_regionkey) AS hit, r.range IN (1, 3) AS known FROM nation, range(0, 7) r")
def row_isect_boolmask(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    mask = R.boolmask(F.array(F.col("n_nationkey") % 7, F.col("n_regionkey")), 7)
    known = R.isect_flags(F.sequence(F.lit(0), F.lit(6)), [1, 3])
    both = F.arrays_zip(mask.alias("hit"), known.alias("known"))
    return n.select("n_nationkey", F.posexplode(both).alias("i", "p")).select("n_nationkey", "i", "p.hit", "p.known")


@query("row_gmean", f"WITH {_V} SELECT vec_id, round(exp(list_avg(list_transform(v, lambda x: ln(abs(x) + 0.1)))), 6) AS gmean FROM v")
def row_gmean(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(R.gmean(F.transform("v", lambda x: F.abs(x) + 0.1)), 6).alias("gmean"))


@query("arr_argsort_flat", f"WITH {_E} SELECT row_number() OVER (ORDER BY e.v, d0 * 64 + d1) - 1 AS d0, d0 * 64 + d1 AS v FROM e")
def arr_argsort_flat(spark, sf_dir):
    """All cells as one sequence."""
    return _matrix(spark, sf_dir).view(-1).argsort(0).df


@query("arr_pad_modes", f"WITH {_E}, {_N}, a AS (SELECT unnest(range(n + 3)) AS i, n FROM n), c AS (SELECT i AS d0, b.range AS d1, CASE WHEN i < 2 THEN 2 - i WHEN i - 2 < n THEN i - 2 ELSE 2 * n - i END AS s0, CASE WHEN b.range < 1 THEN 1 WHEN b.range > 64 THEN 62 ELSE b.range - 1 END AS s1 FROM a, range(0, 66) b) SELECT c.d0, c.d1, v FROM c JOIN e ON e.d0 = s0 AND e.d1 = s1")
def arr_pad_modes(spark, sf_dir):
    """Reflection on all sides."""
    return _matrix(spark, sf_dir).pad([(2, 1), (1, 1)], mode="reflect").df


@query("arr_matmul_batch", f"WITH {_E}, w AS (SELECT d0, d1 // 8 AS i, d1 % 8 AS k, v FROM e) SELECT a.d0, a.i AS d1, b.i AS d2, round(sum(a.v * b.v), 6) AS v FROM w a JOIN w b ON a.d0 = b.d0 AND a.k = b.k GROUP BY 1, 2, 3")
def arr_matmul_batch(spark, sf_dir):
    """Each vector as an 8 x 8 matrix, times its transpose."""
    m = _matrix(spark, sf_dir).view(-1, 8, 8)
    return _out(m.matmul(m.transpose((0, 2, 1))))


@query("arr_matvec", f"WITH {_E} SELECT d0, round(sum(v * (d1 + 1)), 4) AS v FROM e GROUP BY 1")
def arr_matvec(spark, sf_dir):
    return _out(_matrix(spark, sf_dir).matmul(Tensor.from_numpy(spark, [float(i + 1) for i in range(64)])), 4)


@query("arr_one_hot", "SELECT r.range AS d0, vec_id AS d1, CASE WHEN label = r.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM embeddings, range(0, 10) r")
def arr_one_hot(spark, sf_dir):
    """Labels as unit columns: the new axis comes first."""
    df = table(spark, sf_dir, "embeddings")
    n = df.agg(F.max("vec_id")).first()[0] + 1
    return Tensor(df.select(F.col("vec_id").alias("d0"), F.col("label").alias("v")), (n,)).one_hot(10, axis=0).df


@query(
    "dtype_table",
    """WITH t AS (SELECT * FROM (VALUES ('int8', 'i', 8, 'tinyint'), ('int16', 'i', 16, 'smallint'), ('int32', 'i', 32, 'int'), ('int64', 'i', 64, 'bigint'), ('uint8', 'u', 8, 'smallint'), ('uint16', 'u', 16, 'int'), ('uint32', 'u', 32, 'bigint'), ('uint64', 'u', 64, 'decimal(20,0)'), ('float32', 'f', 32, 'float'), ('float64', 'f', 64, 'double'), ('complex64', 'c', 64, 'struct<re:float,im:float>')) t(dtype, of, bits, kind)),
    f AS (SELECT *, CASE WHEN bits = 64 AND of = 'f' THEN 52 ELSE 23 END AS digits, CASE WHEN bits = 64 AND of = 'f' THEN 1023 ELSE 127 END AS top FROM t)
    SELECT dtype, bits, CASE of WHEN 'i' THEN -pow(2.0::DOUBLE, bits - 1) WHEN 'u' THEN 0 ELSE -(2 - pow(2.0::DOUBLE, -digits)) * pow(2.0::DOUBLE, top) END AS low,
    CASE of WHEN 'i' THEN pow(2.0::DOUBLE, bits - 1) - 1 WHEN 'u' THEN pow(2.0::DOUBLE, bits) - 1 ELSE (2 - pow(2.0::DOUBLE, -digits)) * pow(2.0::DOUBLE, top) END AS high, kind FROM f""",
)
def dtype_table(spark, sf_dir):
    names = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "complex64")
    rows = [(d["dtype"], d["bits"], float(d["min"]), float(d["max"]), T.spark_type(d["dtype"])) for d in map(T.dtype_info, names)]
    return spark.createDataFrame(rows, "dtype string, bits int, low double, high double, kind string")
