"""Queries over random numbers, distributions, set cover and assignment."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import functions as F

from arrayloom.functions import distributions as D  # noqa: N812
from arrayloom.functions import random as N  # noqa: N812
from arrayloom.operators import assign, cover
from arrayloom.plans.registry import query, table
from arrayloom.plans.stats_queries import rounded


def u(seed, row="id"):
    """hash_uniform in DuckDB."""
    return f"((('0x' || substr(md5('{seed}:' || ({row})::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


_R = "r AS (SELECT range::BIGINT AS id FROM range(0, 2000))"


@query("hash_uniform", f"WITH {_R} SELECT id, round({u(7)}, 9) AS u, round(-2 + 5 * {u(8)}, 9) AS v FROM r")
def hash_uniform(spark, sf_dir):
    return rounded(spark.range(2000).select("id", N.hash_uniform("id", 7).alias("u"), N.uniform("id", -2, 3, 8).alias("v")), ["u", "v"], 9)


def z(seed, row="id"):
    return f"(sqrt(-2 * ln({u(seed, row)})) * cos({2 * math.pi!r} * {u(seed, f'({row})::VARCHAR || chr(39)')}))"


@query("hash_normal", f"WITH {_R} SELECT id, round(10 + 3 * {z(5)}, 6) AS z FROM r")
def hash_normal(spark, sf_dir):
    return rounded(spark.range(2000).select("id", N.standard_normal("id", 10, 3, 5).alias("z")), ["z"])


@query("uniform32", f"WITH {_R} SELECT id, {u(3)}::FLOAT::DOUBLE AS u FROM r")
def uniform32(spark, sf_dir):
    return spark.range(2000).select("id", N.uniform32("id", seed=3).cast("double").alias("u"))


@query("normal32", f"WITH {_R} SELECT id, round({z(6)}, 4) AS z FROM r")
def normal32(spark, sf_dir):
    return spark.range(2000).select("id", F.round(N.standard_normal32("id", seed=6).cast("double"), 4).alias("z"))


@query("seed_global", f"WITH {_R} SELECT id, round({u(77)}, 9) AS a, round({u(78)}, 9) AS b FROM r")
def seed_global(spark, sf_dir):
    """Draws without a seed of their own follow the session's."""
    was = spark.conf.get("arrayloom.seed", "0")
    N.seed_global(spark, 77)
    a = N.uniform("id")
    N.seed_global(spark, 77, offset=1)
    b = N.uniform("id")
    spark.conf.set("arrayloom.seed", was)
    return rounded(spark.range(2000).select("id", a.alias("a"), b.alias("b")), ["a", "b"], 9)


@query("shuffle", f"SELECT n_nationkey, row_number() OVER (ORDER BY {u(11, 'n_nationkey')}, n_nationkey) - 1 AS pos FROM nation")
def shuffle(spark, sf_dir):
    return N.shuffled(table(spark, sf_dir, "nation"), "n_nationkey", 11).select("n_nationkey", "pos")


@query("random_combinations", f"SELECT a.n_nationkey AS c0, b.n_nationkey AS c1, c.n_nationkey AS c2 FROM nation a JOIN nation b ON b.n_nationkey > a.n_nationkey JOIN nation c ON c.n_nationkey > b.n_nationkey ORDER BY {u(2, 'concat_ws(chr(44), a.n_nationkey, b.n_nationkey, c.n_nationkey)')}, 1, 2, 3 LIMIT 1000")
def random_combinations(spark, sf_dir):
    return N.random_combinations(table(spark, sf_dir, "nation"), "n_nationkey", 3, 1000, seed=2)


def whole(seed, row, below):
    """hash_whole in DuckDB."""
    return f"(('0x' || substr(md5('{seed}:' || ({row})::VARCHAR), 1, 15))::BIGINT % {below})"


@query(
    "random_combinations_sparse",
    f"""WITH i AS (SELECT c_custkey AS x, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer), n AS (SELECT count(*) AS n FROM i), d AS (SELECT range::BIGINT AS d FROM range(0, 1064)),
    t AS (SELECT d, list_sort([{", ".join(whole(3, f"d || ',{k}'", "n") for k in range(3))}]) AS p FROM d, n), k AS (SELECT min(d) AS d, p FROM t WHERE len(list_distinct(p)) = 3 GROUP BY p ORDER BY 1 LIMIT 500)
    SELECT a.x AS c0, b.x AS c1, c.x AS c2 FROM k JOIN i a ON a.p = k.p[1] JOIN i b ON b.p = k.p[2] JOIN i c ON c.p = k.p[3]""",
)
def random_combinations_sparse(spark, sf_dir):
    """500 of all triples of customers."""
    return N.random_combinations(table(spark, sf_dir, "customer"), "c_custkey", 3, 500, seed=3)


@query("random_product", f"WITH p AS (SELECT range::BIGINT AS id FROM range(0, 12)) SELECT [1, 2, 3][id // 4 + 1] AS c0, [4, 5, 6, 7][id % 4 + 1] AS c1 FROM p ORDER BY {u(4)}, id LIMIT 7")
def random_product(spark, sf_dir):
    return N.random_product(spark, [[1, 2, 3], [4, 5, 6, 7]], 7, seed=4)


@query("random_product_sparse", f"WITH d AS (SELECT range::BIGINT AS d FROM range(0, 2064)), t AS (SELECT min(d) AS d, id FROM (SELECT d, {whole(9, 'd', 10**12)} AS id FROM d) GROUP BY id ORDER BY 1 LIMIT 1000) SELECT (id // 1000000000)::INTEGER AS c0, (id // 1000000 % 1000)::INTEGER AS c1, (id // 1000 % 1000)::INTEGER AS c2, (id % 1000)::INTEGER AS c3 FROM t")
def random_product_sparse(spark, sf_dir):
    """A thousand different tuples out of 10^12."""
    return N.random_product(spark, [list(range(1000))] * 4, 1000, seed=9)


def _draw(spark, dist, seed=1):
    return spark.range(2000).select("id", dist.sample("id", seed).alias("x"))


def _dist(name, sql, dist, digits=6):
    """A query that draws 2000 numbers."""

    @query(f"dist_{name}", f"WITH {_R} SELECT id, {sql} AS x FROM r")
    def run(spark, sf_dir):
        out = _draw(spark, dist())
        return out if digits is None else rounded(out, ["x"], digits)

    return run


_dist("uniform", f"round(2 + 3 * {u(1)}, 6)", lambda: D.Uniform(5, 2))
_dist("exponential", f"round(-4 * ln(1 - {u(1)}), 6)", lambda: D.Exponential(4))
_dist("constant", "7", lambda: D.Constant(7), None)
_dist("discrete_uniform", f"floor(3 + {u(1)} * 6)::BIGINT", lambda: D.DiscreteUniform(3, 9), None)
_dist("normal", f"round(10 + 2 * {z(1)}, 6)", lambda: D.Normal(10, 2))
_dist("bernoulli", f"{u(1)} < 0.3::DOUBLE", lambda: D.Bernoulli(0.3), None)
_dist("binomial", "(" + " + ".join(f"({u(1, f'id::VARCHAR || chr(35) || {i}')} < 0.4::DOUBLE)::BIGINT" for i in range(1, 6)) + ")", lambda: D.Binomial(0.4, 5), None)
_dist("categorical", f"CASE WHEN {u(1)} < 0.5 THEN 'a' WHEN {u(1)} < 0.75 THEN 'b' ELSE 'c' END", lambda: D.Categorical(["a", "b", "c"], [2, 1, 1]), None)
_dist("category_uniform", f"['x', 'y', 'z'][floor({u(1)} * 3)::INT + 1]", lambda: D.CategoryUniform(["x", "y", "z"]), None)
_dist("nonlinear_exp", f"round((exp({u(1)}) - 1) / {math.e - 1!r} * 100, 5)", lambda: D.NonlinearUniform(0, 100, "exp"), 5)
_dist("nonlinear_sqrt_reverse", f"round(sqrt(1 - {u(1)}) * 2 + 1, 6)", lambda: D.NonlinearUniform(1, 3, "sqrt", True))
_dist("nonlinear_power", f"round(pow({u(1)}, 2.5), 6)", lambda: D.NonlinearUniform(0, 1, 2.5))
_dist("pdf", f"round(CASE WHEN {u(1)} < 0.25 THEN {u(1)} * 8 WHEN {u(1)} < 0.75 THEN 2 + ({u(1)} - 0.25) * 4 ELSE 4 + ({u(1)} - 0.75) * 8 END, 6)", lambda: D.PDF((0, 6), [1, 2, 1]))
_dist("mixture", f"round(CASE WHEN {u('1.choice')} < 0.25 THEN {u('1.0')} ELSE 10 + 2 * {z('1.1')} END, 6)", lambda: D.Mixture([D.Uniform(), D.Normal(10, 2)], [1, 3]))
_dist("composed", f"round(least(greatest((2 * {u('1.0.0.0.1')} + 1) - {u('1.0.1')}, 0.5), 1.5), 6)", lambda: ((2 * D.Uniform() + 1) - D.Uniform()).clip(0.5, 1.5))


def _quantile(p):
    """normal_quantile in DuckDB."""

    def ratio(tables, r):
        parts = []
        for values in tables:
            out = repr(values[-1]) + "::DOUBLE"
            for v in reversed(values[:-1]):
                out = f"({out} * {r} + {v!r}::DOUBLE)"
            parts.append(out)
        return f"{parts[0]} / {parts[1]}"

    q, far = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1.0::DOUBLE - {p})))"
    side = f"CASE WHEN {far} <= 5 THEN {ratio(D.QUANTILE_SIDE, f'({far} - 1.6::DOUBLE)')} ELSE {ratio(D.QUANTILE_TAIL, f'({far} - 5.0::DOUBLE)')} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(D.QUANTILE_CENTRE, f'(0.180625::DOUBLE - {q} * {q})')} ELSE sign({q}) * ({side}) END"


_CUT = [statistics.NormalDist(10, 3).cdf(x) for x in (8, 13)]


@query("dist_truncnormal", f"WITH {_R}, p AS (SELECT id, {_CUT[0]!r}::DOUBLE + {u(1)} * {_CUT[1] - _CUT[0]!r}::DOUBLE AS p FROM r) SELECT id, round(least(greatest(10 + 3 * ({_quantile('p')}), 8.0::DOUBLE), 13.0::DOUBLE), 6) AS x FROM p")
def dist_truncnormal(spark, sf_dir):
    return rounded(_draw(spark, D.TruncNormal(10, 3, 8, 13)), ["x"])


@query("dist_histogram", f"WITH {_R}, x AS (SELECT {u(1)} AS x FROM r), m AS (SELECT min(x) AS a, max(x) AS b FROM x) SELECT least(9, floor((x - a) / ((b - a) / 10)))::INTEGER AS bin, count(*)::BIGINT AS n FROM x, m GROUP BY 1")
def dist_histogram(spark, sf_dir):
    h = D.Uniform().histogram(spark.range(2000), bins=10, seed=1)
    from pyspark.sql import Window

    return h.select((F.row_number().over(Window.orderBy("low")) - 1).alias("bin"), "n")


@query("dist_algebra", f"WITH {_R} SELECT id, round(sqrt(abs({z('3.0.0.0')})) + pow(-2 * ln(1 - {u('3.1.0')}), 2), 5) AS x, round(sqrt(abs({z('4.0.0.0')})) + pow(-2 * ln(1 - {u('4.1.0')}), 2), 5) AS y FROM r")
def dist_algebra(spark, sf_dir):
    """A tree of operations: each leaf draws by its own place in it."""
    tree = abs(D.Normal(0, 1)).sqrt() + D.Exponential(2) ** 2
    return rounded(spark.range(2000).select("id", tree.sample("id", 3).alias("x"), tree.sample("id", 4).alias("y")), ["x", "y"], 5)


@query("setcover_greedy", "SELECT * FROM (VALUES (0, 'a'), (1, 'c'), (2, 'd')) t(step, set_id)")
def setcover_greedy(spark, sf_dir):
    return _cover(spark, "approx")


@query("setcover_exact", "SELECT * FROM (VALUES (0, 'b'), (1, 'e')) t(step, set_id)")
def setcover_exact(spark, sf_dir):
    return _cover(spark, "exact")


def _cover(spark, algo):
    sets = {"a": [1, 2, 3, 8, 9, 0], "b": [1, 2, 3, 4, 5], "c": [4, 5, 7], "d": [5, 6, 7], "e": [6, 7, 8, 9, 0]}
    df = spark.createDataFrame([(s, x) for s, xs in sets.items() for x in xs], "set_id string, item int")
    found = cover.setcover(df, "set_id", "item", algo)
    return spark.createDataFrame(list(enumerate(found)), "step int, set_id string")


def _greedy_sql(gain, cost, limit, steps):
    """The greedy loop unrolled over order priorities and customers: each step takes the set of most gain among what is left."""
    parts = ["r1 AS (SELECT DISTINCT o_orderpriority AS s, o_custkey AS x FROM orders)"]
    for k in range(1, steps + 1):
        spent = f"(SELECT {cost} FROM b{k - 1}) + (SELECT w FROM w{k - 1})" if k > 1 else "0"
        parts.append(f"w{k} AS (SELECT {spent} AS w)")
        parts.append(f"b{k} AS (SELECT s, sum({gain}) AS g FROM r{k} WHERE (SELECT w FROM w{k}) < {limit} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)")
        parts.append(f"r{k + 1} AS (SELECT * FROM r{k} WHERE s <> (SELECT s FROM b{k}) AND x NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = (SELECT s FROM b{k})))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {k - 1} AS step, s AS set_id FROM b{k}" for k in range(1, steps + 1))


@query("setcover_priorities", _greedy_sql("1", "1", 3, 3))
def setcover_priorities(spark, sf_dir):
    """Which order priorities, in turn, reach the most customers not yet reached."""
    orders = table(spark, sf_dir, "orders")
    found = cover.greedy_cover(orders, "o_orderpriority", "o_custkey", max_weight=3)
    return spark.createDataFrame(list(enumerate(found)), "step int, set_id string")


@query("setcover_values", _greedy_sql("x % 7 + 1", "CASE WHEN s = '1-URGENT' THEN 2 ELSE 1 END", 4, 4))
def setcover_values(spark, sf_dir):
    """The same with values of customers and weights of priorities."""
    orders = table(spark, sf_dir, "orders")
    values = orders.select("o_custkey").distinct().withColumn("value", F.col("o_custkey") % 7 + 1)
    found = cover.greedy_cover(orders, "o_orderpriority", "o_custkey", values, {"1-URGENT": 2}, max_weight=4)
    return spark.createDataFrame(list(enumerate(found)), "step int, set_id string")


@query(
    "setcover_regions",
    """WITH s AS (SELECT DISTINCT n_regionkey AS g, n_nationkey AS s, c_mktsegment || c_custkey % 12 AS x FROM customer JOIN nation ON c_nationkey = n_nationkey),
    n AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s) - 1 AS i FROM (SELECT DISTINCT g, s FROM s)), m AS (SELECT g, mask FROM (SELECT DISTINCT g FROM n), (SELECT range AS mask FROM range(1, 32))),
    c AS (SELECT m.g, mask, count(DISTINCT x) AS covered FROM m JOIN n ON n.g = m.g AND (mask >> i) & 1 = 1 JOIN s ON s.g = n.g AND s.s = n.s GROUP BY 1, 2), a AS (SELECT g, count(DISTINCT x) AS items FROM s GROUP BY 1)
    SELECT g AS n_regionkey, min(bit_count(mask))::BIGINT AS sets FROM c JOIN a USING (g) WHERE covered = items GROUP BY 1""",
)
def setcover_regions(spark, sf_dir):
    """The fewest nations of each region whose customers have all its pairs of segment and customer number modulo 12."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sets = c.select("n_regionkey", "n_nationkey", F.concat("c_mktsegment", (F.col("c_custkey") % 12).cast("string")).alias("item"))
    return cover.exact_covers(sets, ["n_regionkey"], "n_nationkey", "item").groupBy("n_regionkey").agg(F.count("*").alias("sets"))


def _matching(edges, i, j, best):
    """The best total of each problem over all matchings, row by row: edges is SQL for (problem, i, j, w)."""
    return f"""WITH RECURSIVE w AS ({edges}), o AS (SELECT problem, i, row_number() OVER (PARTITION BY problem ORDER BY i) AS k FROM (SELECT DISTINCT problem, i FROM w)),
    e AS (SELECT o.problem, o.k, w.j, w.w, 1 AS one FROM o JOIN w ON w.problem = o.problem AND w.i = o.i UNION ALL SELECT problem, k, NULL, 0, 0 FROM o),
    t AS (SELECT DISTINCT problem, 0::BIGINT AS k, []::BIGINT[] AS used, 0 AS n, 0.0::DOUBLE AS total FROM w UNION ALL
    SELECT t.problem, e.k, CASE WHEN e.j IS NULL THEN used ELSE list_append(used, e.j::BIGINT) END, n + one, total + e.w FROM t JOIN e ON e.problem = t.problem AND e.k = t.k + 1 WHERE e.j IS NULL OR NOT list_contains(used, e.j::BIGINT)),
    f AS (SELECT problem, n, total FROM t JOIN (SELECT problem, max(k) AS k FROM o GROUP BY 1) USING (problem, k)) {best}"""


_SUPPLIES = "SELECT s_nationkey AS problem, m AS i, s_suppkey AS j, {w} AS w FROM supplier, (SELECT range AS m FROM range(0, 4))"


def _edges(spark, sf_dir):
    """What each of four posts costs with each supplier of a nation."""
    s = table(spark, sf_dir, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    return s.select(F.col("s_nationkey").alias("problem"), "i", F.col("s_suppkey").alias("j"), F.abs(F.col("s_acctbal") - 2500 * F.col("i") + 40 * (F.col("s_suppkey") % 7)).alias("cost"))


def _totals(df, weight):
    return df.groupBy("problem").agg(F.count("*").alias("pairs"), F.round(F.sum(weight), 4).alias("total"))


_FEWEST = "SELECT f.problem, f.n::BIGINT AS pairs, round(min(total), 4) AS total FROM f JOIN (SELECT problem, max(n) AS n FROM f GROUP BY 1) USING (problem, n) GROUP BY 1, 2"


@query("mincost", _matching(_SUPPLIES.format(w="abs(s_acctbal - 2500 * m + 40 * (s_suppkey % 7))"), "i", "j", _FEWEST))
def mincost(spark, sf_dir):
    """Posts of each nation, each given to one supplier, at the least cost in all."""
    return _totals(assign.mincost_assignment(_edges(spark, sf_dir), ["problem"], "i", "j", "cost"), "cost")


@query("maxvalue", _matching(f"SELECT * FROM ({_SUPPLIES.format(w='2000 - abs(s_acctbal - 2500 * m + 40 * (s_suppkey % 7))')}) WHERE w > 0", "i", "j", "SELECT problem, round(max(total), 4) AS total FROM f GROUP BY 1"))
def maxvalue(spark, sf_dir):
    """The same by value; what is worth nothing isn't assigned."""
    worth = _edges(spark, sf_dir).withColumn("cost", 2000 - F.col("cost"))
    return _totals(assign.maxvalue_assignment(worth, ["problem"], "i", "j", "cost"), "cost").drop("pairs")


@query(
    "mindist",
    _matching(
        "SELECT a.label + 10 * (a.vec_id // 50) AS problem, a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))) AS w FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 50 = b.vec_id // 50 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1",
        "i",
        "j",
        _FEWEST.replace(", 4)", ", 3)"),
    ),
)
def mindist(spark, sf_dir):
    """Even and odd vectors of each label, fifty ids at a time, in pairs of least distance in all."""
    v = table(spark, sf_dir, "embeddings").select((F.col("label") + 10 * F.floor(F.col("vec_id") / 50)).alias("problem"), "vec_id", "embedding")
    left = v.where("vec_id % 2 = 0").select("problem", F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    right = v.where("vec_id % 2 = 1").select("problem", F.col("vec_id").alias("j"), F.col("embedding").alias("b"))
    out = assign.mindist_assignment(left, right, ["problem"], "i", "j", "a", "b")
    return out.groupBy("problem").agg(F.count("*").alias("pairs"), F.round(F.sum("dist"), 3).alias("total"))
