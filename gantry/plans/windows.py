"""Queries over the ranking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.functions import stats as S
from gantry.operators import windows as W
from gantry.plans.base import query


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS place_in_size FROM part WHERE p_retailprice <= 1200""")
def rank_in_group(t):
    admitted = t.part.where("p_retailprice <= 1200")
    return W.rank_within(admitted, {"place": ["p_brand"], "place_in_size": ["p_brand", "p_size"]}, [F.col("p_retailprice").desc(), F.col("p_partkey")]).select("p_partkey", "place", "place_in_size")


@query("""SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_type, p_partkey) AS k FROM part) WHERE k = 1""")
def fastest_config(t):
    order = [F.col("p_retailprice").desc(), F.col("p_size").desc(), F.col("p_type"), F.col("p_partkey")]
    return W.best_by(t.part, ["p_brand"], order).select("p_brand", "p_partkey", "p_retailprice")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1""")
def canonical_observation(t):
    order = [F.col("o_orderstatus") != "F", F.col("o_orderpriority"), F.col("o_orderkey")]
    return W.best_by(t.orders, ["o_custkey"], order).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_size % 4 AS cards, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS o, row_number() OVER (PARTITION BY p_brand, p_size % 4 ORDER BY p_retailprice DESC, p_partkey) AS w, min(p_size % 4) OVER (PARTITION BY p_brand) AS least FROM part),
c AS (SELECT *, CASE WHEN w = 1 AND cards = least THEN 0 WHEN o = 1 THEN 1 WHEN w = 1 THEN 2 ELSE 3 END AS tier FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, o) AS place FROM c) SELECT p_brand, p_partkey, cards, tier, place FROM p WHERE place <= 6""")
def shortlist_topk(t):
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice", (F.col("p_size") % 4).alias("cards"))
    return W.shortlist(rows, ["p_brand"], "cards", [F.col("p_retailprice").desc(), F.col("p_partkey")], 6).drop("p_retailprice")


@query("""WITH k AS (SELECT DISTINCT p_brand, CAST(pow(2, p_size % 3) AS BIGINT) AS gpu, p_partkey % 3 AS z, p_size % 2 AS gc, 1 + p_size % 4 AS mbs FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, gpu ORDER BY gc, z, mbs DESC, gpu) AS c, row_number() OVER (PARTITION BY p_brand, gpu, z, gc ORDER BY gc, z, mbs DESC, gpu) AS s, row_number() OVER (PARTITION BY p_brand ORDER BY gc, z, mbs DESC, gpu) AS o FROM k),
t AS (SELECT *, max(CASE WHEN c = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand, gpu, z, gc) AS taken FROM r), u AS (SELECT *, CASE WHEN c = 1 THEN 0 WHEN s = 1 AND taken = 0 THEN 1 ELSE 2 END AS tier FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, CASE WHEN tier = 0 THEN gpu ELSE 0 END, o) AS place FROM u), n AS (SELECT p_brand, count(DISTINCT gpu) AS n FROM k GROUP BY p_brand)
SELECT p.p_brand, gpu, z, gc, mbs, tier, place FROM p JOIN n ON p.p_brand = n.p_brand WHERE place <= greatest(5, n)""")
def bounded_shortlist(t):
    keys = t.part.select("p_brand", F.pow(F.lit(2), F.col("p_size") % 3).cast("long").alias("gpu"), (F.col("p_partkey") % 3).alias("z"), (F.col("p_size") % 2).alias("gc"), (F.col("p_size") % 4 + 1).alias("mbs")).distinct()
    return W.bounded_shortlist(keys, ["p_brand"], "gpu", ["gpu", "z", "gc"], [F.col("gc"), F.col("z"), F.col("mbs").desc(), F.col("gpu")], 5)


_POINTS = "p AS (SELECT p_brand, CAST(pow(2, p_size % 5) AS INTEGER) AS cards, avg(p_retailprice) * pow(1.75, p_size % 5) AS v FROM part GROUP BY p_brand, p_size % 5)"


def _points(t):
    rows = t.part.groupBy("p_brand", (F.col("p_size") % 5).alias("e")).agg(F.avg("p_retailprice").alias("v"))
    return rows.select("p_brand", F.pow(F.lit(2), "e").cast("int").alias("cards"), (F.col("v") * F.pow(F.lit(1.75), "e")).alias("v"))


@query(f"""WITH {_POINTS}, l AS (SELECT *, lag(v) OVER w AS p0, first_value(v) OVER w AS b FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY cards))
SELECT p_brand, cards, round(v, 5) AS v, round((v - p0) / p0, 9) AS gain, round(v / b, 8) AS speedup, round(v / b / cards, 9) AS efficiency, p0 IS NULL OR (v - p0) / p0 >= 0.75 AS passes FROM l""")
def scaling_lag(t):
    out = W.scaling(_points(t), ["p_brand"], "cards", "v", 0.75)
    return out.withColumns({"v": F.round("v", 5), "gain": F.round("gain", 9), "speedup": F.round("speedup", 8), "efficiency": F.round("efficiency", 9)})


@query(f"""WITH {_POINTS}, q AS (SELECT p_brand, cards, CASE WHEN cards = 4 AND p_brand < 'Brand#15' THEN NULL ELSE v END AS v FROM p), l AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY cards ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p0 FROM q),
f AS (SELECT *, coalesce(v / p0 < 1.752, false) AS bad FROM l), s AS (SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY p_brand ORDER BY cards ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM f)
SELECT p_brand, cards, round(v / p0, 8) AS ratio, CASE WHEN stopped THEN 'skipped_by_early_stop' WHEN v IS NULL THEN 'pending' WHEN bad THEN 'fail' ELSE 'pass' END AS decision FROM s""")
def early_stop(t):
    points = _points(t).withColumn("v", F.when(~((F.col("cards") == 4) & (F.col("p_brand") < "Brand#15")), F.col("v")))
    return W.early_stop(points, ["p_brand"], "cards", "v", 1.752).select("p_brand", "cards", F.round("ratio", 8).alias("ratio"), "decision")


@query(f"""WITH RECURSIVE {_POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cards) AS i FROM p), w AS (SELECT p_brand, i, cards, v, false AS done FROM o WHERE i = 1
UNION ALL SELECT w.p_brand, o.i, CASE WHEN NOT done AND (o.v - w.v) / w.v >= 0.75 THEN o.cards ELSE w.cards END, CASE WHEN NOT done AND (o.v - w.v) / w.v >= 0.75 THEN o.v ELSE w.v END, done OR (o.v - w.v) / w.v < 0.75 FROM w JOIN o ON o.p_brand = w.p_brand AND o.i = w.i + 1)
SELECT p_brand, arg_max(cards, i) AS default_cards, round(arg_max(v, i), 5) AS default_value FROM w GROUP BY p_brand""")
def default_walk(t):
    return W.default_walk(_points(t), ["p_brand"], "cards", "v", 0.75).withColumn("default_value", F.round("default_value", 5))


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS y FROM part)
SELECT p_brand, round(corr(x, y), 9) AS rho, count(*) AS n FROM r GROUP BY p_brand""")
def spearman_ties(t):
    return W.spearman(t.part, ["p_brand"], "p_size", "p_retailprice").withColumn("rho", F.round("rho", 9))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS y FROM part) SELECT p_brand, round(corr(x, y), 9) AS rho, count(*) AS n FROM r GROUP BY p_brand""")
def spearman_ordinal(t):
    return W.spearman_ordinal(t.part, ["p_brand"], "p_size", "p_retailprice", "p_partkey").withColumn("rho", F.round("rho", 9))


@query("""SELECT a.p_brand, count(*) AS pairs, CAST(sum(CASE WHEN sign(a.p_size - b.p_size) = sign(a.p_retailprice - b.p_retailprice) THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN sign(a.p_size - b.p_size) = sign(a.p_retailprice - b.p_retailprice) THEN 1 ELSE 0 END), 9) AS accuracy
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_retailprice <> b.p_retailprice GROUP BY a.p_brand""")
def pairwise_accuracy(t):
    return W.pairwise_accuracy(t.part, ["p_brand"], "p_size", "p_retailprice").withColumn("accuracy", F.round("accuracy", 9))


@query("""WITH s AS (SELECT p_brand, arg_max(p_retailprice, struct_pack(a := p_size, b := -p_partkey)) AS sel, max(p_retailprice) AS best FROM part GROUP BY p_brand) SELECT p_brand, round(greatest(0, 1 - sel / best), 9) AS regret, greatest(0, 1 - sel / best) <= 0.1 AS hit FROM s""")
def top1_regret(t):
    return W.top_regret(t.part, ["p_brand"], "p_size", "p_retailprice", "p_partkey").withColumn("regret", F.round("regret", 9))


@query("""SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS delta FROM events""")
def counter_delta(t):
    return W.counter_delta(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("delta", 6).alias("delta"))


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, (SELECT count(DISTINCT user_id) FROM events) AS s, (SELECT count(*) FROM events) AS total FROM events)
SELECT event_id, user_id FROM r WHERE total <= 2000 OR (i - 1) % CAST(ceil(n / greatest(1, floor(2000 / s))) AS BIGINT) = 0 OR i = n""")
def downsample_stride(t):
    return W.stride_downsample(t.events, "user_id", ["ts", "event_id"], 2000).select("event_id", "user_id")


@query("""WITH RECURSIVE g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS i FROM g), w AS (SELECT 0 AS i, CAST(NULL AS VARCHAR) AS p_brand, 0 AS fold, CAST([0, 0, 0, 0] AS BIGINT[]) AS load
UNION ALL SELECT o.i, o.p_brand, list_position(w.load, list_min(w.load)) - 1, list_transform(w.load, lambda x, k: CASE WHEN k = list_position(w.load, list_min(w.load)) THEN x + o.n ELSE x END) FROM w JOIN o ON o.i = w.i + 1)
SELECT p_brand, fold FROM w WHERE i > 0""")
def balanced_folds(t):
    sizes = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return W.balanced_folds(sizes, "p_brand", "n", 4)


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, median(o_totalprice) AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT o_custkey, o_orderpriority, round(m, 3) AS m, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY m DESC, o_orderpriority) AS k FROM f) WHERE k = 1""")
def fastest_by_scenario(t):
    per = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderpriority").agg(S.median("o_totalprice").alias("m"), F.count("*").alias("n"))
    return W.best_by(per, ["o_custkey"], [F.col("m").desc(), F.col("o_orderpriority")]).withColumn("m", F.round("m", 3))
