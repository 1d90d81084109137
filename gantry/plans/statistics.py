"""Queries over the statistics and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gantry.functions import numeric as N
from gantry.functions import stats as S
from gantry.operators import models as M
from gantry.operators import windows as W
from gantry.plans.base import query


@query("""SELECT o_orderkey, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_custkey) FROM orders) * count(*) OVER (PARTITION BY o_custkey)), 9) AS weight FROM orders""")
def scenario_weights(t):
    return M.scenario_weights(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", F.round("weight", 9).alias("weight"))


_RANK = """r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"""


@query(f"""WITH {_RANK}, k AS (SELECT *, CAST(ceil((n + 1) * 0.95::DECIMAL(9, 6)) AS BIGINT) AS rank FROM r) SELECT c_nationkey, max(n) AS n, max(rank) AS rank, max(CASE WHEN i = rank THEN c_acctbal END) AS bound, max(CASE WHEN i = rank THEN c_acctbal END) IS NOT NULL AS identifiable FROM k GROUP BY c_nationkey""")
def conformal_upper(t):
    return M.conformal(t.customer, ["c_nationkey"], "c_acctbal", "0.95")


@query(f"""WITH {_RANK}, k AS (SELECT *, CAST(floor((n + 1) * 0.05::DECIMAL(9, 6)) AS BIGINT) AS rank FROM r) SELECT c_nationkey, max(n) AS n, max(rank) AS rank, max(CASE WHEN i = rank THEN c_acctbal END) AS bound, max(CASE WHEN i = rank THEN c_acctbal END) IS NOT NULL AS identifiable FROM k GROUP BY c_nationkey""")
def conformal_lower(t):
    return M.conformal(t.customer, ["c_nationkey"], "c_acctbal", "0.95", upper=False)


@query("""WITH g AS (SELECT user_id, round(value) AS v, count_if(event_type <> 'error') AS d, count(*) AS m FROM events GROUP BY ALL), r AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY v DESC) AS risk FROM g),
s AS (SELECT *, product(1 - d / risk) OVER (PARTITION BY user_id ORDER BY v) AS s, sum(d) OVER (PARTITION BY user_id ORDER BY v) AS e FROM r)
SELECT user_id, CAST(sum(m) AS BIGINT) AS n, min(CASE WHEN d > 0 AND s <= 0.2 + 1e-12 THEN v END) AS quantile, CAST(min(CASE WHEN d > 0 AND s <= 0.2 + 1e-12 THEN e END) AS BIGINT) AS rank, min(CASE WHEN d > 0 AND s <= 0.2 + 1e-12 THEN v END) IS NOT NULL AS identifiable FROM s GROUP BY user_id""")
def kaplan_meier(t):
    rows = t.events.select("user_id", F.round("value").alias("v"), (F.col("event_type") != "error").alias("event"))
    return M.kaplan_meier(rows, ["user_id"], "v", "event", 0.8)


@query("""WITH c AS (SELECT p_brand, p_size, avg(p_retailprice) AS v, count(*) AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i FROM part GROUP BY p_brand, p_size), s AS (SELECT a.p_brand, a.i AS j, b.i AS k, (SELECT sum(v * w) / sum(w) FROM c WHERE c.p_brand = a.p_brand AND c.i BETWEEN a.i AND b.i) AS m FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.i <= b.i),
h AS (SELECT c.p_brand, c.p_size, s.j, min(s.m) AS m FROM c JOIN s ON c.p_brand = s.p_brand AND s.j <= c.i AND s.k >= c.i GROUP BY ALL) SELECT p_brand, p_size, round(max(m), 4) AS fitted FROM h GROUP BY ALL""")
def isotonic(t):
    rows = t.part.select("p_brand", "p_size", "p_retailprice", F.lit(1.0).alias("w"))
    return M.isotonic_fit(rows, ["p_brand"], "p_size", "p_retailprice", "w").withColumn("fitted", F.round("fitted", 4))


_XY = "SELECT l_suppkey, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem"


@query(f"""WITH d AS ({_XY}), m AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d), b AS (SELECT *, ((sxx + 10) * sy - sx * sxy) / (n * (sxx + 10) - sx * sx) AS b0, (n * sxy - sx * sy) / (n * (sxx + 10) - sx * sx) AS b1 FROM m)
SELECT round(b0, 6) AS b0, round(b1, 8) AS b1 FROM b""")
def ridge(t):
    g = next(iter(M.gram(t.lineitem, {"x": F.col("l_quantity")}, F.col("l_extendedprice") / 1000).values()))
    b = g.ridge(10.0)
    return t.spark.createDataFrame([(round(float(b[0]), 6), round(float(b[1]), 8))], "b0 double, b1 double")


@query(f"""WITH d AS ({_XY}), k AS (SELECT l_suppkey, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d GROUP BY l_suppkey), a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM k),
r AS (SELECT l_suppkey, a.n - k.n AS n, a.sx - k.sx AS sx, a.sy - k.sy AS sy, a.sxx - k.sxx AS sxx, a.sxy - k.sxy AS sxy FROM k, a), b AS (SELECT l_suppkey, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM r),
e AS (SELECT d.l_suppkey, abs(b0 + b1 * x - y) / abs(y) AS e FROM d JOIN b ON d.l_suppkey = b.l_suppkey) SELECT l_suppkey, round(avg(e), 6) AS mape, round(median(e), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90, count(*) AS n FROM e GROUP BY l_suppkey""")
def loso_regression(t):
    rows = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    scored = rows.join(M.left_out_lines(rows, "l_suppkey", "x", "y"), "l_suppkey").withColumn("p", F.col("b0") + F.col("b1") * F.col("x"))
    return M.errors(scored, ["l_suppkey"], "p", "y").withColumns({c: F.round(c, 6) for c in ("mape", "median", "p90")})


@query("""WITH m AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS s, avg(p_retailprice) AS b, stddev_pop(p_retailprice) AS u FROM part) SELECT p_partkey, round((p_size - a) / s, 8) AS z_p_size, round((p_retailprice - b) / u, 8) AS z_p_retailprice FROM part, m""")
def standardised(t):
    return M.standardised(t.part, ["p_size", "p_retailprice"]).select("p_partkey", F.round("z_p_size", 8).alias("z_p_size"), F.round("z_p_retailprice", 8).alias("z_p_retailprice"))


@query("""WITH x AS (SELECT p_partkey, tanh((p_size - 25) / 10.0 / 3) * 3 AS a, p_partkey % 2 AS g FROM part) SELECT p_partkey, round(a, 9) AS a, round(a * a, 9) AS a_sq, round(g * a, 9) AS g_a FROM x""")
def basis_expansion(t):
    rows = t.part.select("p_partkey", ((F.col("p_size") - 25) / 10.0).alias("a"), (F.col("p_partkey") % 2).alias("g"))
    return rows.select("p_partkey", *(F.round(c, 9).alias(n) for n, c in M.expanded(["a"], ["g"]).items()))


@query("""WITH c AS (SELECT p_partkey, p_retailprice * exp(tanh((p_size - 25) / 10.0) * 0.1) AS center, p_retailprice * (1 + p_size / 100.0) * 1.05 AS r FROM part) SELECT p_partkey, round(center, 6) AS center, round(greatest(center, r), 6) AS upper, greatest(center, r) <= 1300 AS admitted FROM c""")
def memory_admission(t):
    out = M.admission(t.part, F.col("p_retailprice"), N.bounded((F.col("p_size") - 25) / 100.0, 0.1), F.col("p_retailprice") * (F.col("p_size") / 100.0 + 1), 1.05, 1300)
    return out.select("p_partkey", F.round("center", 6).alias("center"), F.round("upper", 6).alias("upper"), "admitted")


@query("""SELECT p_brand, round(greatest(0, sum(p_size * (p_retailprice - 930)) / sum(p_size * p_size)), 8) AS slope FROM part GROUP BY p_brand""")
def scalar_nnls(t):
    return t.part.groupBy("p_brand").agg(F.round(M.nonnegative_slope(F.col("p_size"), F.col("p_retailprice") - 930), 8).alias("slope"))


@query("""WITH g AS (SELECT p_retailprice AS c, p_size > 48 AND p_partkey % 7 = 0 AS f, p_retailprice * (1 + p_partkey % 10 / 50.0) AS o, 1 + m / 100.0 AS m FROM part, (SELECT unnest(range(0, 31)) AS m)),
p AS (SELECT m, count_if(f AND c * m <= 1100) AS false_admits, avg(CASE WHEN NOT f THEN CASE WHEN c * m >= o THEN 1 ELSE 0 END END) AS coverage FROM g GROUP BY m) SELECT round(m, 6) AS m, false_admits, round(coverage, 9) AS coverage FROM p ORDER BY false_admits, coverage DESC, m LIMIT 1""")
def multiplier_scan(t):
    failed = (F.col("p_size") > 48) & (F.col("p_partkey") % 7 == 0)
    out = M.multiplier_scan(t.part, F.col("p_retailprice"), failed, F.col("p_retailprice") * (F.col("p_partkey") % 10 / 50.0 + 1), 1100, [1 + k / 100 for k in range(31)])
    return out.select(F.round("m", 6).alias("m"), "false_admits", F.round("coverage", 9).alias("coverage"))


@query("""WITH g AS (SELECT p_retailprice AS c, p_size > 48 AND p_partkey % 7 = 0 AS f, p_retailprice * (1 + p_partkey % 10 / 50.0) AS o, 1 + m / 100.0 AS m FROM part, (SELECT unnest(range(0, 301)) AS m)),
p AS (SELECT m, count_if(f AND c * m <= 1100) AS false_admits, avg(CASE WHEN NOT f THEN CASE WHEN c * m >= o THEN 1 ELSE 0 END END) AS coverage FROM g GROUP BY m) SELECT round(m, 6) AS m, false_admits, round(coverage, 9) AS coverage FROM p ORDER BY false_admits, coverage DESC, m LIMIT 1""")
def multiplier_scan_301(t):
    """`multiplier_scan` over the reference's 301 candidates."""
    failed = (F.col("p_size") > 48) & (F.col("p_partkey") % 7 == 0)
    out = M.multiplier_scan(t.part, F.col("p_retailprice"), failed, F.col("p_retailprice") * (F.col("p_partkey") % 10 / 50.0 + 1), 1100, [1 + k / 100 for k in range(301)])
    return out.select(F.round("m", 6).alias("m"), "false_admits", F.round("coverage", 9).alias("coverage"))


@query("""WITH d AS (SELECT 1.0 / count(*) OVER (PARTITION BY p_brand) AS w, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), m AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM d), b AS (SELECT *, (sxy - sx * sy / sw) / (sxx - sx * sx / sw + 2) AS s FROM m)
SELECT round(s, 8) AS slope, round((sy - s * sx) / sw, 6) AS intercept, round(sy / sw, 6) AS constant FROM b""")
def group_equal_fit(t):
    out = M.group_equal_fit(t.part, "p_brand", F.col("p_size"), F.col("p_retailprice"), 2.0)
    return out.select(F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("constant", 6).alias("constant"))


@query("""WITH k AS (SELECT DISTINCT p_brand FROM part), f AS (SELECT p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1) % 5 AS fold FROM k) SELECT fold, count(*) AS n, sha256(string_agg(CAST(p_partkey AS VARCHAR), chr(10) ORDER BY CAST(p_partkey AS VARCHAR))) AS digest FROM part JOIN f ON part.p_brand = f.p_brand GROUP BY fold""")
def fold_membership(t):
    return M.folds(t.part, "p_brand", "p_partkey", 5).withColumn("fold", F.col("fold").cast("long"))


@query("""WITH a AS (SELECT a.p_brand, avg(CASE WHEN sign(a.p_size - b.p_size) = sign(a.p_retailprice - b.p_retailprice) THEN 1 ELSE 0 END) AS acc FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_retailprice <> b.p_retailprice GROUP BY a.p_brand),
r AS (SELECT p_brand, greatest(0, 1 - arg_max(p_retailprice, struct_pack(a := p_size, b := -p_partkey)) / max(p_retailprice)) AS regret FROM part GROUP BY p_brand) SELECT a.p_brand, round(acc, 9) AS accuracy, round(regret, 9) AS regret, acc >= 0.5 AND regret <= 0.09 AS passed FROM a JOIN r ON a.p_brand = r.p_brand""")
def ranking_acceptance(t):
    acc = W.pairwise_accuracy(t.part, ["p_brand"], "p_size", "p_retailprice")
    both = acc.join(W.top_regret(t.part, ["p_brand"], "p_size", "p_retailprice", "p_partkey"), "p_brand")
    passed = N.all_pass([N.gate("accuracy", F.col("accuracy"), ">=", 0.5), N.gate("regret", F.col("regret"), "<=", 0.09)])
    return both.select("p_brand", F.round("accuracy", 9).alias("accuracy"), F.round("regret", 9).alias("regret"), passed.alias("passed"))


@query("""WITH p AS (SELECT p_brand, count(*) AS n, count(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand) SELECT p_brand, 'n' AS measure, n::DOUBLE AS actual, 80.0::DOUBLE AS required FROM p WHERE n < 80 UNION ALL SELECT p_brand, 'sizes', sizes::DOUBLE, 40.0::DOUBLE FROM p WHERE sizes < 40""")
def evidence_gaps(t):
    per = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_size").alias("sizes"))
    return M.evidence_gaps(per, "p_brand", {"n": 80, "sizes": 40})


@query("""WITH f2 AS (SELECT p_brand, p_type, regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part GROUP BY ALL HAVING count(*) >= 16 AND max(p_size) - min(p_size) >= 40), f1 AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part GROUP BY ALL HAVING count(*) >= 16 AND max(p_size) - min(p_size) >= 40),
f0 AS (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part) SELECT p_partkey, round(coalesce(f2.i + f2.s * p_size, f1.i + f1.s * p_size, f0.i + f0.s * p_size), 5) AS predicted, CASE WHEN f2.s IS NOT NULL THEN 2 WHEN f1.s IS NOT NULL THEN 1 ELSE 0 END AS level
FROM part p LEFT JOIN f2 ON p.p_brand = f2.p_brand AND p.p_type = f2.p_type LEFT JOIN f1 ON p.p_brand = f1.p_brand, f0""")
def routed_regression(t):
    return M.routed(t.part, ["p_brand", "p_type"], "p_size", "p_retailprice", 16, 40).select("p_partkey", F.round("predicted", 5).alias("predicted"), "level")


@query("""SELECT round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 5) AS vif FROM lineitem""")
def collinearity(t):
    out = M.collinearity(t.lineitem, {"q": F.col("l_quantity"), "p": F.col("l_extendedprice")})
    return t.spark.createDataFrame([(round(float(out["q"]), 5),)], "vif double")


@query("""WITH c AS (SELECT min(CASE WHEN toxic = 1 THEN doc_id % 997 END) AS cut FROM labels) SELECT doc_id, coalesce(doc_id % 997 < cut, true) AS admitted FROM labels, c""")
def safety_threshold(t):
    return M.safety_threshold(t.labels.withColumn("s", F.col("doc_id") % 997), "s", F.col("toxic") == 1).select("doc_id", "admitted")


@query("""SELECT p_partkey, round(p_retailprice * 1e6 + p_size * 2000 + p_size * p_size * 16, 3) AS memory, round(p_retailprice / 1000 + 0.002 * p_size + exp(0.01 * p_size) * 0.01, 9) AS seconds, round(p_size / (p_retailprice / 1000 + 0.002 * p_size + exp(0.01 * p_size) * 0.01), 7) AS rate FROM part""")
def overlay_prediction(t):
    seconds = F.col("p_retailprice") / 1000 + F.lit(0.002) * F.col("p_size") + F.exp(F.col("p_size") * 0.01) * 0.01
    memory = M.linear([F.col("p_retailprice"), F.col("p_size"), F.col("p_size") * F.col("p_size")], [0.0, 1e6, 2000.0, 16.0])
    return t.part.select("p_partkey", F.round(memory, 3).alias("memory"), F.round(seconds, 9).alias("seconds"), F.round(S.rate("p_size", seconds), 7).alias("rate"))


def _coefficients(t, values, names=None):
    return t.spark.createDataFrame([(names[i] if names else f"b{i}", round(float(v), 5)) for i, v in enumerate(values)], "term string, value double")


@query()
def huber_fit(t):
    return _coefficients(t, M.huber_fit(t.lineitem, {"q": F.col("l_quantity")}, F.col("l_extendedprice") / 1000, rounds=4))


@query()
def censored_ridge(t):
    return _coefficients(t, M.censored_ridge(t.part, {"size": F.col("p_size") / 50}, F.col("p_retailprice") / 1000, F.col("p_partkey") % 5 == 0, delta=0.2))


@query()
def logistic(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars", "source"), "doc_id").withColumn("y", F.col("toxic") == 1)
    return _coefficients(t, M.logistic_ridge(M.balanced(rows, "source", F.col("y")), {"len": F.log1p("n_chars")}, F.col("y"), F.col("weight"), rounds=8))


@query("""WITH d AS (SELECT b.p_size / 50.0 - a.p_size / 50.0 AS x, b.p_retailprice - a.p_retailprice AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey),
m AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) + 1 AS sxx, sum(x * y) AS sxy FROM d)
SELECT 'b0' AS term, round((sxx * sy - sx * sxy) / (n * sxx - sx * sx), 5) AS value FROM m UNION ALL SELECT 'b1', round((n * sxy - sx * sy) / (n * sxx - sx * sx), 5) FROM m""")
def pairwise_ranker(t):
    g = M.pair_gram(t.part.withColumn("x", F.col("p_size") / 50), "p_brand", "p_partkey", ["x"], "p_retailprice")
    return _coefficients(t, g.ridge(1.0))


@query()
def nested_cv(t):
    x = {"size": F.col("p_size") / 50, "size_sq": F.pow(F.col("p_size") / 50, 2), "key": F.col("p_partkey") / 1e4}
    candidates = {f"{'+'.join(names)}@{alpha}": (names, alpha) for names in (["size"], ["key"], ["size", "key"], ["size", "size_sq", "key"]) for alpha in (1e-6, 10.0)}
    out = M.nested_cv(t.part, "p_brand", x, F.log(F.col("p_retailprice")), candidates)
    return out.withColumns({c: F.round(c, 8) for c in ("inner_error", "outer_error")})


@query()
def profiler_calibration(t):
    points = t.part.where("p_size <= 10").withColumn("role", F.when(F.col("p_partkey") % 3 == 0, "holdout").otherwise("calibration"))
    x = {"adapter": (F.col("p_partkey") % 2).cast("double"), "gc": (F.col("p_size") % 2).cast("double")}
    _, out = M.role_calibration(points, "p_partkey", "role", x, F.col("p_retailprice") / 900, F.lit(900.0), F.col("p_retailprice"))
    return out.groupBy("used_as").agg(F.count("*").alias("n"), F.round(F.avg("error"), 8).alias("mape"))


_TAIL = """r AS (SELECT p_brand, p_type, p_retailprice - 1000 AS v, p_size >= 45 AS cens FROM part), g AS (SELECT * FROM r WHERE NOT cens),
a AS (SELECT p_brand, p_type, v, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY v) AS i, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM g), b AS (SELECT p_type, v, row_number() OVER (PARTITION BY p_type ORDER BY v) AS i, count(*) OVER (PARTITION BY p_type) AS n FROM g),
c AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM g),
t0 AS (SELECT p_brand, p_type, max(n) AS n0, max(CASE WHEN i = ceil((n + 1) * 0.9::DECIMAL(9, 6)) THEN v END) AS t0 FROM a GROUP BY ALL), t1 AS (SELECT p_type, max(n) AS n1, max(CASE WHEN i = ceil((n + 1) * 0.9::DECIMAL(9, 6)) THEN v END) AS t1 FROM b GROUP BY ALL),
t2 AS (SELECT max(CASE WHEN i = ceil((n + 1) * 0.9::DECIMAL(9, 6)) THEN v END) AS t2 FROM c), f AS (SELECT p_brand, p_type, greatest(0, max(v)) AS oom_floor FROM r WHERE cens GROUP BY ALL)"""


@query(f"""WITH {_TAIL}, k AS (SELECT DISTINCT p_brand, p_type FROM r), j AS (SELECT k.p_brand, k.p_type, CASE WHEN n0 >= 20 AND t0 IS NOT NULL THEN 0 WHEN n1 >= 20 AND t1 IS NOT NULL THEN 1 ELSE 2 END AS level, t0, t1, t2, oom_floor FROM k LEFT JOIN t0 ON k.p_brand = t0.p_brand AND k.p_type = t0.p_type LEFT JOIN t1 ON k.p_type = t1.p_type LEFT JOIN f ON k.p_brand = f.p_brand AND k.p_type = f.p_type, t2),
l AS (SELECT p_brand, p_type, level, greatest(0, CASE level WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END) AS tail, oom_floor FROM j) SELECT p_brand, p_type, level, tail, oom_floor, greatest(tail, coalesce(oom_floor, 0)) AS guard FROM l""")
def memory_tails(t):
    rows = t.part.select("p_brand", "p_type", (F.col("p_retailprice") - 1000).alias("v"), "p_size")
    return M.memory_tails(rows, "p_brand", "p_type", "v", F.col("p_size") >= 45, "0.9", 20)


@query("""SELECT p_brand, p_size, count(*) AS replicates, round(median(p_retailprice * 1.1), 6) AS predicted_upper, 1800.0::DOUBLE AS safe_limit, round(median(p_retailprice), 6) AS observed, round(median(p_partkey * 2.0::DOUBLE), 6) AS rate, round(median(p_partkey * 2.5::DOUBLE), 6) AS predicted_rate,
round(median(p_partkey * 2.5::DOUBLE / 1.25::DOUBLE), 6) AS predicted_rate_lower, bool_or(p_partkey % 11 = 0) AS failed, median(p_retailprice * 1.1) <= 1800 AS admitted, NOT bool_or(p_partkey % 11 = 0) AND median(p_retailprice) <= 1800 AS safe FROM part GROUP BY p_brand, p_size""")
def joint_candidates(t):
    rows = t.part.select(
        "p_brand", "p_size", F.when(F.col("p_partkey") % 11 == 0, "oom").otherwise("success").alias("outcome"), (F.col("p_retailprice") * 1.1).alias("upper"), F.lit(1800.0).alias("limit"), "p_retailprice",
        (F.col("p_partkey") * 2.0).alias("rate"), (F.col("p_partkey") * 2.5).alias("predicted"),
    )
    out = M.joint_candidates(rows, ["p_brand", "p_size"], "outcome", "upper", "limit", "p_retailprice", "rate", "predicted", 1.25)
    return out.withColumns({c: F.round(c, 6) for c in ("predicted_upper", "observed", "rate", "predicted_rate", "predicted_rate_lower")})


def _joint(t):
    """Sizes of a brand as candidates of one to eight cards, each with replicates."""
    cards = F.pow(F.lit(2), F.col("p_size") % 4).cast("long")
    rows = t.part.select(
        "p_brand", "p_size", cards.alias("cards"), F.when(F.col("p_partkey") % 41 == 0, "oom").otherwise("success").alias("outcome"), (F.col("p_retailprice") * 1.1).alias("upper"), F.lit(1700.0).alias("limit"), "p_retailprice",
        (F.col("p_retailprice") * F.pow(F.lit(1.9), F.col("p_size") % 4) + F.col("p_size")).alias("rate"), (F.col("p_retailprice") * cards).alias("predicted"),
    )
    return M.joint_candidates(rows, ["p_brand", "p_size", "cards"], "outcome", "upper", "limit", "p_retailprice", "rate", "predicted", 1.25)


_JOINT = """j AS (SELECT p_brand, p_size, CAST(pow(2, p_size % 4) AS BIGINT) AS cards, median(p_retailprice * 1.1) <= 1700 AS admitted, bool_or(p_partkey % 41 = 0) AS failed, median(p_retailprice) AS observed,
median(p_retailprice * pow(1.9, p_size % 4) + p_size) AS rate, median(p_retailprice * CAST(pow(2, p_size % 4) AS BIGINT)) AS predicted, median(p_retailprice * CAST(pow(2, p_size % 4) AS BIGINT) / 1.25::DOUBLE) AS lower FROM part GROUP BY ALL),
c AS (SELECT *, NOT failed AND observed <= 1700 AS safe FROM j)"""


@query(f"""WITH {_JOINT}, g AS (SELECT p_brand, cards, count(*) AS candidates, count_if(safe) AS real_safe, count_if(admitted) AS rankable, count_if(admitted AND (failed OR observed > 1700)) AS safety_failures,
arg_max(p_size, [lower, -p_size]) FILTER (WHERE admitted) AS selected, arg_max(rate, [lower, -p_size]) FILTER (WHERE admitted) AS got, max(rate) FILTER (WHERE safe) AS oracle FROM c GROUP BY p_brand, cards)
SELECT p_brand, cards, candidates, real_safe, rankable, safety_failures, selected, round(oracle, 6) AS oracle, CASE WHEN oracle IS NOT NULL THEN round(CASE WHEN selected IS NULL THEN 1 ELSE greatest(0, (oracle - got) / oracle) END, 9) END AS regret, CASE WHEN oracle IS NOT NULL THEN coalesce(got >= 0.9 * oracle, false) END AS hit FROM g""")
def gated_ranking(t):
    out = M.gated_ranking(_joint(t), ["p_brand", "cards"], "p_size")
    return out.withColumns({"oracle": F.round("oracle", 6), "regret": F.round("regret", 9)})


@query(f"""WITH {_JOINT}, s AS (SELECT p_brand, cards, arg_max(predicted, [lower, -p_size]) AS p, arg_max(rate, [lower, -p_size]) AS r FROM c WHERE admitted GROUP BY p_brand, cards),
d AS (SELECT a.p_brand, substr(a.p_brand, 7, 1) AS fold, a.cards AS from_cards, b.p / a.p AS predicted_ratio, b.r / a.r AS observed_ratio, ln((b.r / a.r) / (b.p / a.p)) AS residual FROM s a JOIN s b ON a.p_brand = b.p_brand AND b.cards = 2 * a.cards),
o AS (SELECT f.fold AS held, residual, row_number() OVER (PARTITION BY f.fold ORDER BY residual) AS i, count(*) OVER (PARTITION BY f.fold) AS n FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold),
q AS (SELECT held, max(CASE WHEN i = CAST(floor((n + 1) * 0.1::DECIMAL(9, 6)) AS BIGINT) THEN residual END) AS bound FROM o GROUP BY held)
SELECT p_brand, from_cards, round(predicted_ratio, 6) AS predicted_ratio, round(observed_ratio, 6) AS observed_ratio, round(predicted_ratio * exp(bound), 6) AS lower_ratio, coalesce(predicted_ratio * exp(bound) >= 1.4, false) AS claimed, observed_ratio >= 1.4 AS cleared FROM d LEFT JOIN q ON held = fold""")
def scaling_claims(t):
    pairs = M.scaling_pairs(_joint(t), "p_brand", "cards", "p_size").withColumn("fold", F.substring("p_brand", 7, 1))
    out = M.scaling_claims(pairs, "fold", "0.9", least=1.4)
    return out.select("p_brand", F.col("from_cards").cast("long").alias("from_cards"), *(F.round(c, 6).alias(c) for c in ("predicted_ratio", "observed_ratio", "lower_ratio")), "claimed", "cleared")


@query()
def theory_calibration(t):
    x = {"size": F.col("p_size") / 50, "key": F.col("p_partkey") / 1e4}
    out = M.theory_calibration(t.part, scenario="p_brand", selector="p_brand", mode="p_type", features=x, target="p_retailprice", censored=F.col("p_size") >= 45, coverage="0.9", least=20)
    covered = (F.col("p_size") < 45) & (F.col("p_retailprice") <= F.col("upper"))
    return out.groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.sum(covered.cast("int")) / F.count_if(F.col("p_size") < 45), 4).alias("coverage"), F.count_if((F.col("p_size") >= 45) & (F.col("upper") < F.col("p_retailprice"))).alias("false_safe"))


@query("""WITH x AS (SELECT p_partkey, CAST(pow(2, p_size % 3) AS BIGINT) AS g, p_partkey % 4 AS z, p_retailprice AS w, p_size % 2 AS gc, 1 + p_size % 4 AS mbs FROM part), c AS (SELECT *, NOT (g = 1 AND z >= 2) AS ok, 2000 + 12 * w + 500 * mbs - 1500 * gc AS m FROM x)
SELECT p_partkey, ok AS feasible, CASE WHEN ok THEN round(m, 6) END AS center, CASE WHEN ok THEN round(m + 900, 6) END AS upper, coalesce(ok AND m + 900 + 800 < 18000, false) AS admitted, CASE WHEN ok THEN round(exp(6 + 0.3 * mbs - 0.1 * gc), 6) END AS rate,
CASE WHEN NOT ok THEN 'sharding_needs_cards' WHEN m > 40000 THEN 'beyond_fit' WHEN m + 900 + 800 >= 18000 THEN 'too_close_to_limit' END AS note, CASE WHEN ok AND mbs NOT IN (1, 2, 4) THEN 'mbs' ELSE '' END AS outside FROM c""")
def compact_prediction(t):
    mbs, gc = (F.col("p_size") % 4 + 1), (F.col("p_size") % 2)
    x = {"w": F.col("p_retailprice"), "mbs": mbs, "gc": gc}
    c = M.compact_prediction(
        x, {"1": 2000.0, "w": 12.0, "mbs": 500.0, "gc": -1500.0}, {"1": 6.0, "mbs": 0.3, "gc": -0.1}, cards=F.pow(F.lit(2), F.col("p_size") % 3).cast("long"), stage=F.col("p_partkey") % 4,
        margin=900.0, card_memory=18000.0, trained={"mbs": (mbs, (1, 2, 4))},
    )
    rounded = {k: F.round(c[k], 6) for k in ("center", "upper", "rate")} | {"outside": F.array_join(c["outside"], ",")}
    return t.part.select("p_partkey", *((rounded.get(k, v)).alias(k) for k, v in c.items()))


@query()
def spline_fit(t):
    basis = M.spline_basis(F.col("p_size") / 50, [0.25, 0.5, 0.75])
    return _coefficients(t, next(iter(M.gram(t.part, basis, F.col("p_retailprice") / 1000).values())).ridge(1e-3))


@query()
def subset_sweep(t):
    x = {"size": F.col("p_size") / 50, "size_sq": F.pow(F.col("p_size") / 50, 2), "key": F.col("p_partkey") / 1e4}
    found = M.subset_sweep(t.part.withColumn("fold", F.crc32("p_brand") % 5), x, F.col("p_retailprice") / 1000, "fold", 2)
    return t.spark.createDataFrame([(",".join(names), round(float(loss), 9)) for loss, names in found], "features string, loss double")


def _candidates(t):
    """Means of the brands' sizes: a small table of scenarios and candidates for the fits on the driver."""
    return t.part.groupBy("p_brand", (F.col("p_size") % 8).alias("c")).agg(F.avg("p_size").alias("x"), F.avg("p_retailprice").alias("y")).orderBy("p_brand", "c").toPandas()


@query()
def structured_fit(t):
    d = _candidates(t)
    fit = M.StructuredFit().fit(np.column_stack([d["x"] / 50, d["c"] / 8]), np.log(d["y"].to_numpy()), d["p_brand"].to_numpy())
    return _coefficients(t, fit.coefficients)


@query()
def tobit_fit(t):
    d = _candidates(t)
    y = np.log(d["y"].to_numpy())
    top = np.quantile(y, 0.8)
    return _coefficients(t, M.tobit(d[["x"]].to_numpy() / 50, np.minimum(y, top), y >= top))


@query()
def stage_curve(t):
    d = _candidates(t)
    return _coefficients(t, M.curve_fit(lambda x, b: b[0] + b[1] * np.exp(b[2] * x), [0.9, 0.01, 0.5], d["x"].to_numpy() / 50, d["y"].to_numpy() / 1000))


@query()
def optimal_design(t):
    d = _candidates(t)
    chosen = M.determinant_design(np.column_stack([d["x"] / 50, d["c"] / 8, (d["x"] / 50) ** 2]), 4)
    return t.spark.createDataFrame([(int(i), d["p_brand"][i]) for i in chosen], "row int, p_brand string")


@query()
def forest_scores(t):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").withColumn("label", F.col("toxic").cast("double")).withColumn("en", (F.col("lang") == "en").cast("int"))
    data = VectorAssembler(inputCols=["n_chars", "en"], outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=8, maxDepth=4, seed=1).fit(data)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(data).select("doc_id", "toxic", F.round(vector_to_array("probability")[1], 9).alias("score"))
    return M.safety_threshold(scored, "score", F.col("toxic") == 1).select("doc_id", "score", "admitted")
