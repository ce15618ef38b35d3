"""Queries over grouping, statistics and top-k operators, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrayloom.operators import groups, stats, topk
from arrayloom.plans.registry import query, table


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "stats_by_event",
    """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS "q_0_25",
    round(quantile_cont(value, 0.5), 6) AS "q_0_50", round(quantile_cont(value, 0.75), 6) AS "q_0_75", round(median(value), 6) AS med, round(sum(value), 4) AS sum, count(*)::BIGINT AS size FROM events GROUP BY event_type""",
)
def stats_by_event(spark, sf_dir):
    out = stats.stats(table(spark, sf_dir, "events"), "value", ["event_type"], median=True, sum=True, size=True)
    return rounded(rounded(out, ["mean", "std", "q_0_25", "q_0_50", "q_0_75", "med"]), ["sum"], 4)


@query(
    "stats_n_extreme",
    """WITH m AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)
    SELECT l.l_returnflag, min(l_quantity) AS min, max(l_quantity) AS max, count(*) FILTER (l_quantity = lo)::BIGINT AS "nMin", count(*) FILTER (l_quantity = hi)::BIGINT AS "nMax"
    FROM lineitem l JOIN m USING (l_returnflag) GROUP BY 1""",
)
def stats_n_extreme(spark, sf_dir):
    out = stats.stats(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"], n_extreme=True, quantile=None)
    return out.select("l_returnflag", "min", "max", "nMin", "nMax")


@query(
    "stats_nan_omitted",
    """WITH e AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS v FROM events)
    SELECT event_type, round(avg(v) FILTER (NOT isnan(v)), 6) AS mean, round(stddev_pop(v) FILTER (NOT isnan(v)), 6) AS std, min(v) FILTER (NOT isnan(v)) AS min, max(v) FILTER (NOT isnan(v)) AS max,
    count(*) FILTER (isnan(v))::BIGINT AS num_nan FROM e GROUP BY 1""",
)
def stats_nan_omitted(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))
    return rounded(stats.stats(e, "v", ["event_type"], nan=True, quantile=None), ["mean", "std"])


def _running(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return stats.running(items, "l_quantity", by=["l_suppkey", "month"])


@query(
    "running_stats_merge",
    """SELECT l_suppkey, sum(l_quantity) AS total, sum(l_quantity * l_quantity) AS squares, max(l_quantity) AS max, min(l_quantity) AS min, count(*)::DOUBLE AS n, round(avg(l_quantity), 6) AS mean,
    round(coalesce(stddev_samp(l_quantity), 'nan'::DOUBLE), 6) AS std FROM lineitem GROUP BY 1""",
)
def running_stats_merge(spark, sf_dir):
    """Accumulators by supplier and month, merged by supplier: the partial states are what is stored."""
    return rounded(stats.summary(stats.merged(_running(spark, sf_dir), ["l_suppkey"])), ["mean", "std"])


@query(
    "running_stats_marginal",
    """SELECT strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_quantity), 6) AS mean, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1
    UNION ALL SELECT 'all', round(avg(l_quantity), 6), count(*)::DOUBLE FROM lineitem""",
)
def running_stats_marginal(spark, sf_dir):
    """One set of accumulators, marginalised over suppliers and over everything."""
    states = _running(spark, sf_dir)
    by_month = stats.summary(stats.merged(states, ["month"])).select("month", "mean", "n")
    whole = stats.summary(stats.merged(states)).select(F.lit("all").alias("month"), "mean", "n")
    return rounded(by_month.unionByName(whole), ["mean"])


@query(
    "weighted_stats",
    """SELECT l_returnflag, round(sum(l_discount * l_quantity), 4) AS total, round(sum(pow(l_discount * l_quantity, 2)), 4) AS squares, round(sum(l_discount), 4) AS n,
    max(l_quantity) FILTER (l_discount <> 0) AS max, min(l_quantity) FILTER (l_discount <> 0) AS min, round(sum(l_discount * l_quantity) / sum(l_discount), 6) AS mean FROM lineitem GROUP BY 1""",
)
def weighted_stats(spark, sf_dir):
    out = stats.summary(stats.running(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"])).drop("std")
    return rounded(rounded(out, ["total", "squares", "n"], 4), ["mean"])


@query(
    "weighted_std",
    """WITH w AS (SELECT l_suppkey, l_quantity * l_tax AS wx, l_tax AS w FROM lineitem), s AS (SELECT l_suppkey, sum(wx) AS t, sum(wx * wx) AS q, sum(w) AS n FROM w GROUP BY 1)
    SELECT l_suppkey, round(t / n, 6) AS mean, round(sqrt(greatest(0.0, (n * q - t * t) / (n * (n - 1)))), 5) AS std FROM s WHERE abs(n * (n - 1)) > 1e-6""",
)
def weighted_std(spark, sf_dir):
    """Squares are those of the weighted values."""
    out = stats.summary(stats.running(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", ["l_suppkey"])).where("abs(n * (n - 1)) > 1e-6")
    return rounded(rounded(out.select("l_suppkey", "mean", "std"), ["mean"]), ["std"], 5)


@query("stats_shape", "SELECT user_id, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stats_shape(spark, sf_dir):
    out = stats.stats(table(spark, sf_dir, "events"), "value", ["user_id"], shape=True, quantile=None, extreme=False)
    return rounded(out.select("user_id", F.col("shape")[0].alias("n"), "mean"), ["mean"])


@query("running_std_single", """SELECT n_regionkey, n_nationkey, sum(n_nationkey)::DOUBLE AS total, 'nan'::DOUBLE AS std FROM nation GROUP BY n_regionkey, n_nationkey HAVING count(*) = 1""")
def running_std_single(spark, sf_dir):
    """The sample std of one observation is NaN, not NULL."""
    return stats.summary(stats.running(table(spark, sf_dir, "nation"), "n_nationkey", by=["n_regionkey", "n_nationkey"])).where("n = 1").select("n_regionkey", "n_nationkey", "total", "std")


_POOL = """WITH g AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
    t AS (SELECT o_orderpriority, sum(n * m) / sum(n) AS mm FROM g GROUP BY 1)
    SELECT o_orderpriority, round(any_value(mm), 4) AS mean, round(sqrt((sum(greatest(n - 1, 0) * {s}) + sum(n * pow(m - mm, 2))) / greatest(sum(n) - 1, 0)), 4) AS std FROM g JOIN t USING (o_orderpriority) GROUP BY 1"""


def _pool(spark, sf_dir, variance):
    g = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count("*").alias("n"))
    return rounded(stats.combine_mean_stds(g, "m", "s", "n", ["o_orderpriority"], variance=variance), ["mean", "std"], 4)


@query("combine_mean_std", _POOL.format(s="s"))
def combine_mean_std(spark, sf_dir):
    return _pool(spark, sf_dir, False)


@query("combine_mean_std_variance", _POOL.format(s="s * s"))
def combine_mean_std_variance(spark, sf_dir):
    return _pool(spark, sf_dir, True)


@query(
    "combine_mean_std_limit",
    """WITH g AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1, 2), t AS (SELECT o_orderpriority, avg(m) AS mm FROM g GROUP BY 1)
    SELECT o_orderpriority, round(any_value(mm), 4) AS mean, round(sqrt(sum(s + pow(m - mm, 2)) / count(*)), 4) AS std FROM g JOIN t USING (o_orderpriority) GROUP BY 1""",
)
def combine_mean_std_limit(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return rounded(stats.combine_mean_stds(g, "m", "s", None, ["o_orderpriority"]), ["mean", "std"], 4)


@query("gmean_price", """SELECT l_linestatus, round(exp(avg(ln(l_extendedprice))), 4) AS gmean FROM lineitem GROUP BY 1""")
def gmean_price(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(stats.gmean("l_extendedprice"), 4).alias("gmean"))


@query("group_items", """SELECT event_type, len(l)::BIGINT AS n, array_to_string(l, ',') AS items FROM (SELECT event_type, list(user_id ORDER BY event_id) AS l FROM events GROUP BY 1)""")
def group_items(spark, sf_dir):
    out = groups.group_items(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id")
    return out.select("event_type", F.size("items").cast("bigint").alias("n"), F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"))


@query("group_indices", """SELECT user_id, count(*)::BIGINT AS n, min(event_id) AS first, max(event_id) AS last, sum(event_id)::BIGINT AS total FROM events GROUP BY 1""")
def group_indices(spark, sf_dir):
    out = groups.group_indices(table(spark, sf_dir, "events"), "user_id", "event_id")
    total = F.aggregate("indices", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.select("user_id", F.size("indices").cast("bigint").alias("n"), F.col("indices")[0].alias("first"), F.element_at("indices", -1).alias("last"), total.alias("total"))


@query("apply_grouping", """SELECT n_regionkey AS gid, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1""")
def apply_grouping(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    found = groups.group_indices(nations, "n_regionkey", "n_nationkey")
    out = groups.apply_grouping(nations, "n_name", "n_nationkey", found, "n_regionkey", "indices")
    return out.select(F.col("n_regionkey").alias("gid"), F.concat_ws(",", "items").alias("names"))


_DAYS = "SELECT DISTINCT user_id, datediff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS day FROM events"


def _days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day")).distinct()


@query(
    "group_consecutive",
    f"""WITH d AS ({_DAYS}), s AS (SELECT *, CASE WHEN day - lag(day) OVER w = 1 THEN 0 ELSE 1 END AS st FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY day) AS island FROM s) SELECT user_id, island::BIGINT AS island, min(day) AS first, max(day) AS last, count(*)::BIGINT AS n FROM i GROUP BY 1, 2""",
)
def group_consecutive(spark, sf_dir):
    """Runs of consecutive days with events, by user."""
    return groups.group_consecutive_indices(_days(spark, sf_dir), "day", "day", ["user_id"])


@query(
    "run_length",
    """WITH s AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s) SELECT conv_id, island::BIGINT AS island, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS n FROM i GROUP BY 1, 2""",
)
def run_length(spark, sf_dir):
    """Runs of turns of one role."""
    return groups.group_consecutive_indices(table(spark, sf_dir, "conversations"), "role", "turn", ["conv_id"], offset=0)


_BOUNDS = "b AS (SELECT o_custkey, n, sum(n) OVER (PARTITION BY o_custkey % 16 ORDER BY o_custkey)::BIGINT AS stop FROM (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1))"


def _bounds(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("part", F.col("o_custkey") % 16)
    return groups.flat_bounds(n, "o_custkey", "n", ["part"])


@query("flat_bounds", f"WITH {_BOUNDS} SELECT o_custkey, n, stop, stop - n AS start FROM b")
def flat_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir).select("o_custkey", "n", "stop", F.col("start").cast("bigint").alias("start"))


@query("flat_ravel", f"WITH {_BOUNDS} SELECT o_custkey, i::BIGINT AS inner_no, (stop - n + i)::BIGINT AS flat FROM (SELECT *, unnest(range(n)) AS i FROM b)")
def flat_ravel(spark, sf_dir):
    bounds = _bounds(spark, sf_dir)
    at = bounds.select("o_custkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("inner_no"))
    return groups.flat_ravel(at, bounds, "o_custkey", "inner_no").select("o_custkey", "inner_no", F.col("flat").cast("bigint").alias("flat"))


@query("flat_unravel", f"WITH {_BOUNDS} SELECT o_custkey % 16 AS part, stop - n + i AS flat, o_custkey AS outer_no, i::BIGINT AS inner_no FROM (SELECT *, unnest(range(n)) AS i FROM b)")
def flat_unravel(spark, sf_dir):
    """All flat places of each part, and some beyond, which are dropped."""
    bounds = _bounds(spark, sf_dir)
    at = groups.flat_length(bounds, ["part"]).select("part", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.col("n"))).alias("flat"))
    return groups.flat_unravel(at, bounds, "o_custkey", "flat", by=["part"]).select("part", "flat", F.col("outer").alias("outer_no"), F.col("inner").cast("bigint").alias("inner_no"))


@query("flat_lengths", "SELECT vec_id, sum(len(embedding)) OVER (ORDER BY vec_id)::BIGINT AS stop, (SELECT sum(len(embedding)) FROM embeddings)::BIGINT AS n FROM embeddings")
def flat_lengths(spark, sf_dir):
    """Lists in one sequence, without groups."""
    bounds = groups.flat_bounds(groups.flat_lengths(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "n")
    return bounds.select("vec_id", "stop").join(F.broadcast(groups.flat_length(bounds)))  # one row


@query(
    "islands_flat",
    """WITH s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM orders WINDOW w AS (ORDER BY o_orderkey)),
    i AS (SELECT *, sum(st) OVER (ORDER BY o_orderkey) AS island FROM s) SELECT island::BIGINT AS island, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*)::BIGINT AS n FROM i GROUP BY 1""",
)
def islands_flat(spark, sf_dir):
    """Runs of one status over all orders, in one sequence."""
    return groups.group_consecutive_indices(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", offset=0)


@query("argmaxima", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def argmaxima(spark, sf_dir):
    return topk.argmaxima(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], 25).select("o_orderkey", "o_totalprice")


@query("argminima", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def argminima(spark, sf_dir):
    return topk.argminima(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], 25).select("o_orderkey", "o_totalprice")


@query("argmaxima_axis", "SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def argmaxima_axis(spark, sf_dir):
    return topk.argmaxima(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], 3, ["o_custkey"]).select("o_custkey", "o_orderkey", "rank")


@query("argminima_axis", "SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def argminima_axis(spark, sf_dir):
    return topk.argminima(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], 2, ["o_custkey"]).select("o_custkey", "o_orderkey", "rank")


@query("arglexmax", "SELECT c_custkey FROM customer ORDER BY c_mktsegment DESC, c_nationkey DESC, c_custkey LIMIT 1")
def arglexmax(spark, sf_dir):
    return topk.arglexmax(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("arglexmax_multi", "SELECT c_custkey FROM customer QUALIFY rank() OVER (ORDER BY c_mktsegment DESC, c_nationkey DESC) = 1")
def arglexmax_multi(spark, sf_dir):
    return topk.arglexmax(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", multi=True)


@query("unique_rows", "SELECT l_returnflag, l_linestatus, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def unique_rows(spark, sf_dir):
    return topk.unique_rows(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("unique_rows_plain", "SELECT DISTINCT p_brand, p_size FROM part")
def unique_rows_plain(spark, sf_dir):
    return topk.unique_rows(table(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query("boolmask", "SELECT r.range AS pos, n_nationkey IS NOT NULL AS flag FROM range(0, 40) r LEFT JOIN nation ON r.range = n_nationkey AND n_regionkey <> 2")
def boolmask(spark, sf_dir):
    return topk.boolmask(table(spark, sf_dir, "nation").where("n_regionkey <> 2"), "n_nationkey", 40)


@query("boolmask_nd", "SELECT a.range AS d0, b.range AS d1, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = a.range AND n_nationkey = b.range) AS flag FROM range(0, 5) a, range(0, 25) b")
def boolmask_nd(spark, sf_dir):
    return topk.boolmask(table(spark, sf_dir, "nation"), ["n_regionkey", "n_nationkey"], (5, 25))


@query("isect_rows", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS flag FROM customer")
def isect_rows(spark, sf_dir):
    return topk.isect_rows(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey").select("c_custkey", "flag")


@query("iter_reduce", "SELECT l_orderkey, l_linenumber, max(greatest(l_quantity, l_extendedprice, l_tax)) AS top FROM lineitem GROUP BY 1, 2")
def iter_reduce(spark, sf_dir):
    """A fold over columns, then over rows of one position."""
    from arrayloom.functions import elementwise as E  # noqa: N812

    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_orderkey", "l_linenumber").agg(F.max(E.fold(E.maximum, ["l_quantity", "l_extendedprice", "l_tax"])).alias("top"))


