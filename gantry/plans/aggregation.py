"""Queries over the aggregation operators; roles of the tables as in the blueprint."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gantry.functions import stats as S
from gantry.operators import aggregates as A
from gantry.operators import windows as W
from gantry.operators.ordered import percentiles
from gantry.plans.base import Tables, query


#: Lines of a task, about: a fixed value.
_LINES = 1 << 19


def _steps(t: Tables):
    """Steps of jobs: an order is a step, its customer the job, its lines the ranks.

    Both tables are dealt by order to as many tasks as the lines need; what follows by step stays there, so that a task's sorts and
    tables of groups are no larger with more lines.
    """
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    tasks = max(t.spark.sparkContext.defaultParallelism, math.ceil(lines.count() / _LINES))
    orders = t.orders.select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")
    rows = lines.repartition(tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("job"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").cast("long").alias("tokens"),
        F.col("l_extendedprice").alias("seconds"), (F.col("l_returnflag") == "R").alias("warmup"),
    )


_STEPS = """rows AS (SELECT o_custkey AS job, l_orderkey AS step, l_linenumber AS rank, CAST(l_quantity AS BIGINT) AS tokens,
 l_extendedprice AS seconds, l_returnflag = 'R' AS warmup FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_REDUCED = _STEPS + """, steps AS (SELECT job, step, CAST(sum(tokens) AS BIGINT) AS tokens, max(seconds) AS seconds, bool_and(warmup) AS warmup FROM rows GROUP BY job, step)"""


@query(f"WITH {_REDUCED} SELECT * FROM steps")
def rank_reduce(t):
    return A.rank_reduce(_steps(t), ["job", "step"], ["tokens"], ["seconds"], "warmup")


@query(f"""WITH {_REDUCED}, any_m AS (SELECT job, bool_or(NOT warmup) AS m FROM steps GROUP BY job),
r AS (SELECT steps.*, row_number() OVER (PARTITION BY steps.job ORDER BY step DESC) AS k FROM steps JOIN any_m ON steps.job = any_m.job WHERE NOT m OR NOT warmup)
SELECT job, count(*) AS window_steps, round(sum(seconds), 2) AS window_seconds, round(quantile_cont(seconds, 0.5), 3) AS p50,
round(quantile_cont(seconds, 0.9), 3) AS p90, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / sum(seconds), 9) AS tokens_rate FROM r WHERE k <= 20 GROUP BY job""")
def rolling_last20(t):
    steps = A.rank_reduce(_steps(t), ["job", "step"], ["tokens"], ["seconds"], "warmup")
    out = A.rolling_window(steps, "job", "step", "seconds", ["tokens"], "warmup")
    return out.select("job", "window_steps", F.round("window_seconds", 2).alias("window_seconds"), F.round("p50", 3).alias("p50"), F.round("p90", 3).alias("p90"), "tokens", F.round("tokens_rate", 9).alias("tokens_rate"))


@query(f"""WITH {_STEPS}, r AS (SELECT job, rank, sum(CASE WHEN NOT warmup THEN seconds END) AS s, max(seconds) AS m, sum(CASE WHEN NOT warmup THEN tokens END) AS k FROM rows GROUP BY job, rank)
SELECT job, round(max(s), 2) AS seconds, max(m) AS peak, count(*) AS ranks, CAST(sum(k) AS BIGINT) AS tokens FROM r GROUP BY job""")
def two_level_rank_max(t):
    return A.rank_totals(_steps(t), "job", "rank", "seconds", ["tokens"], "seconds", ~F.col("warmup")).withColumn("seconds", F.round("seconds", 2))


@query(f"""WITH {_STEPS}, r AS (SELECT job, max(seconds) AS seconds, max(seconds) AS peak, sum(tokens) AS tokens FROM rows GROUP BY job)
SELECT job, seconds, CAST(tokens AS BIGINT) AS tokens, round(CASE WHEN seconds > 1000 THEN tokens / seconds END, 9) AS tokens_per_second FROM r""")
def run_collection(t):
    per = A.rank_reduce(_steps(t), ["job"], ["tokens"], ["seconds"])
    return per.select("job", "seconds", "tokens", F.round(F.when(F.col("seconds") > 1000, S.rate("tokens", "seconds")), 9).alias("tokens_per_second"))


@query("""SELECT o_custkey, o_orderpriority, count(*) AS runs, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'P') AS n_p,
round(median(v), 3) AS o_totalprice_median, min(v) AS o_totalprice_min, max(v) AS o_totalprice_max, round(CASE WHEN count(v) >= 2 THEN stddev_samp(v) / avg(v) END, 9) AS o_totalprice_cv
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS v FROM orders) GROUP BY o_custkey, o_orderpriority""")
def repeat_aggregate(t):
    out = A.repeats(t.orders, ["o_custkey", "o_orderpriority"], "o_orderstatus", ["F", "O", "P"], ["o_totalprice"], "F")
    return out.withColumn("o_totalprice_median", F.round("o_totalprice_median", 3)).withColumn("o_totalprice_cv", F.round("o_totalprice_cv", 9))


@query("""WITH p AS (SELECT *, year(o_orderdate) AS rep FROM orders WHERE o_orderstatus <> 'P'), w AS (SELECT o_custkey, o_orderpriority, count(*) AS planned, list_sort(list(DISTINCT o_orderkey)) AS jobs,
list_sort(list(DISTINCT rep)) AS reps FROM p GROUP BY ALL), g AS (SELECT o_custkey, o_orderpriority, count(*) AS successes, list_sort(list(DISTINCT o_orderkey)) AS jobs, list_sort(list(DISTINCT rep)) AS reps
FROM p WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT w.o_custkey, w.o_orderpriority, planned, coalesce(successes, 0) AS successes,
coalesce(planned = successes AND w.jobs = g.jobs AND w.reps = g.reps, false) AS complete FROM w LEFT JOIN g ON w.o_custkey = g.o_custkey AND w.o_orderpriority = g.o_orderpriority""")
def complete_run_set(t):
    plan = t.orders.where("o_orderstatus <> 'P'").withColumn("rep", F.year("o_orderdate"))
    return A.complete_sets(plan, plan, ["o_custkey", "o_orderpriority"], "o_orderkey", "rep", F.col("o_orderstatus") == "F")


@query("""SELECT l_orderkey, max(l_extendedprice) AS max_allocated, max(l_quantity) AS max_reserved, max(lack) AS lacking, arg_max(req, lack) AS requested FROM
(SELECT *, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS req, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END - coalesce(CASE WHEN l_linestatus = 'O' THEN l_quantity END, 0) AS lack FROM lineitem) GROUP BY l_orderkey""")
def failure_aggregate(t):
    rows = t.lineitem.withColumn("req", F.expr("CASE WHEN l_returnflag = 'R' THEN l_extendedprice END")).withColumn("free", F.expr("CASE WHEN l_linestatus = 'O' THEN l_quantity END"))
    return A.failures(rows, "l_orderkey", "l_extendedprice", "l_quantity", "req", "free")


#: Telemetry from events: whole numbers, so that sums don't depend on the order of adding.
_EVENTS = """SELECT user_id, ts, user_id % 2 AS gpu_index, CAST(round(value * 100) AS BIGINT) % 24000 AS memory, CASE event_type WHEN 'purchase' THEN 20 WHEN 'signup' THEN NULL ELSE 95 END AS utilization,
CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS power, CAST(round(value) AS BIGINT) * 5 AS clock, CAST(round(value) AS BIGINT) % 90 AS temperature, CASE WHEN event_type = 'click' THEN CAST(round(value) AS BIGINT) % 100 END AS fan,
CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_type = 'view' AND value > 480 THEN 1 ELSE 0 END AS sw_thermal, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 0 END AS hw_thermal,
CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_type = 'click' AND value > 490 THEN 1 ELSE 0 END AS sw_power FROM events"""


def _telemetry(t: Tables):
    return t.events.selectExpr(
        "user_id", "ts", "user_id % 2 AS gpu_index", "CAST(round(value * 100) AS BIGINT) % 24000 AS memory", "CASE event_type WHEN 'purchase' THEN 20 WHEN 'signup' THEN NULL ELSE 95 END AS utilization",
        "CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS power", "CAST(round(value) AS BIGINT) * 5 AS clock", "CAST(round(value) AS BIGINT) % 90 AS temperature",
        "CASE WHEN event_type = 'click' THEN CAST(round(value) AS BIGINT) % 100 END AS fan", "CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_type = 'view' AND value > 480 THEN 1 ELSE 0 END AS sw_thermal",
        "CASE WHEN user_id % 5 = 0 THEN NULL ELSE 0 END AS hw_thermal", "CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_type = 'click' AND value > 490 THEN 1 ELSE 0 END AS sw_power",
    )


@query(f"""WITH e AS ({_EVENTS}), b AS (SELECT *, coalesce(utilization, 0) >= 90 AS busy FROM e), a AS (SELECT user_id, max(memory) AS peak_memory, avg(utilization) AS mean_utilization, avg(power) AS mean_power, avg(clock) AS mean_clock, count(*) AS samples, count_if(busy) AS busy_samples,
count(CASE WHEN busy THEN clock END) AS busy_clocks, quantile_cont(CASE WHEN busy THEN clock END, 0.05) AS p5, quantile_cont(CASE WHEN busy THEN clock END, 0.5) AS p50, quantile_cont(CASE WHEN busy THEN clock END, 0.95) AS p95,
quantile_cont(CASE WHEN busy THEN power END, 0.5) AS w50, quantile_cont(CASE WHEN busy THEN power END, 0.95) AS w95, quantile_cont(CASE WHEN busy THEN temperature END, 0.95) AS t95, max(temperature) AS peak_temperature, max(fan) AS peak_fan,
avg(CASE WHEN busy AND clock < 1400 * 0.95 THEN 1 WHEN busy THEN 0 END) AS below_95, avg(CASE WHEN busy AND clock < 1400 * 0.9 THEN 1 WHEN busy THEN 0 END) AS below_90, avg(CASE WHEN busy AND power >= 30000 * 0.98 THEN 1 WHEN busy AND power IS NOT NULL THEN 0 END) AS at_power_limit,
avg(CASE WHEN busy THEN sw_thermal END) AS f1, avg(CASE WHEN busy THEN hw_thermal END) AS f2, avg(CASE WHEN busy THEN sw_power END) AS f3 FROM b GROUP BY user_id),
c AS (SELECT *, p50 / 1400.0 AS clock_ratio, p50 / 2500.0 AS spec_clock_ratio, f1 IS NOT NULL OR f2 IS NOT NULL OR f3 IS NOT NULL AS known, f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AS complete FROM a),
s AS (SELECT *, CASE WHEN f1 > 0 OR f2 > 0 THEN 'thermal_limited|observed_throttle_reason' WHEN f3 > 0 THEN 'power_limited|observed_throttle_reason' WHEN busy_clocks >= 3 AND at_power_limit >= 0.2 AND below_95 >= 0.2 THEN 'power_limited|inferred_power_cap'
WHEN busy_clocks >= 3 AND (clock_ratio < 0.95 OR below_90 >= 0.1) THEN 'downclocked|clock_only' WHEN complete THEN 'normal|no_observed_queried_limiter' WHEN known THEN 'insufficient_data|partial_throttle_reason_support' ELSE 'insufficient_data|missing_throttle_reason' END AS st FROM c)
SELECT user_id, peak_memory, mean_utilization, mean_power, mean_clock, samples, busy_samples, busy_clocks, round(p5, 4) AS busy_clock_p5, round(p50, 4) AS busy_clock_p50, round(p95, 4) AS busy_clock_p95, round(w50, 4) AS busy_power_p50, round(w95, 4) AS busy_power_p95, round(t95, 4) AS busy_temperature_p95,
peak_temperature, peak_fan, below_95, below_90, at_power_limit, f1 AS sw_thermal_fraction, f2 AS hw_thermal_fraction, f3 AS sw_power_fraction, f1 IS NOT NULL AS sw_thermal_known, f2 IS NOT NULL AS hw_thermal_known, f3 IS NOT NULL AS sw_power_known, round(clock_ratio, 9) AS clock_ratio, round(spec_clock_ratio, 9) AS spec_clock_ratio,
known AS limiters_known, complete AS limiters_complete, 1400.0::DOUBLE AS healthy_clock, 2500.0::DOUBLE AS spec_clock, 30000.0::DOUBLE AS power_limit, 90.0::DOUBLE AS busy_from, split_part(st, '|', 1) AS clock_status, split_part(st, '|', 2) AS clock_status_source, split_part(st, '|', 1) IN ('power_limited', 'thermal_limited', 'downclocked') AS downclocked FROM s""")
def telemetry_aggregate(t):
    out = A.telemetry(_telemetry(t), ["user_id"], healthy_clock=1400.0, spec_clock=2500.0, power_limit=30000.0)
    rounded = {c: F.round(c, 4) for c in out.columns if c.startswith("busy_") and c[-2] in "p59"} | {c: F.round(c, 9) for c in ("clock_ratio", "spec_clock_ratio")}
    return out.withColumns({k: v for k, v in rounded.items() if k not in ("busy_samples", "busy_clocks", "busy_from")})


@query(f"""WITH e AS ({_EVENTS}), l AS (SELECT user_id, power, lag(power) OVER w AS p0, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id, gpu_index ORDER BY ts))
SELECT user_id, CAST(coalesce(sum((power + p0) * least(10000000, greatest(0, dt))), 0) AS DOUBLE) / 720000000000 AS energy_wh FROM l GROUP BY user_id""")
def energy_trapezoid(t):
    time = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = _telemetry(t).withColumn("watts", F.col("power") / 100)
    per_card = A.energy(rows, ["user_id", "gpu_index"], time, "watts")
    return per_card.groupBy("user_id").agg(F.sum("energy_wh").alias("energy_wh"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def status_counts(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, o_orderstatus, CAST(grouping_id(o_orderpriority, o_orderstatus) AS BIGINT) AS level, count(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), (o_orderstatus), ())""")
def marginals_grouping_sets(t):
    sets = [["o_orderpriority", "o_orderstatus"], ["o_orderpriority"], ["o_orderstatus"], []]
    return A.marginals(t.orders, sets, n=F.count("*"))


@query(f"""WITH e AS ({_EVENTS}) SELECT user_id, count(*) AS n, count(sw_thermal) AS known, CAST(coalesce(sum(sw_thermal), 0) AS BIGINT) AS active, round(count(sw_thermal) / count(*), 9) AS coverage,
round(sum(sw_thermal) / nullif(count(sw_thermal), 0), 9) AS active_fraction FROM e GROUP BY ROLLUP (user_id)""")
def rollup_flag_coverage(t):
    return A.flag_coverage(_telemetry(t), "user_id", "sw_thermal").withColumn("coverage", F.round("coverage", 9)).withColumn("active_fraction", F.round("active_fraction", 9))


@query("""SELECT source, count(n_chars) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most, round(stddev_pop(n_chars), 5) AS deviation,
round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.95), 4) AS p95, round(quantile_cont(n_chars, 0.99), 4) AS p99 FROM documents GROUP BY source""")
def length_profile(t):
    out = A.length_profile(t.documents, ["source"], "n_chars")
    return out.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 5)} | {f"p{q}": F.round(f"p{q}", 4) for q in (50, 90, 95, 99)})


@query("""SELECT source, cutoff, round(avg(CASE WHEN n_chars > cutoff THEN 1 ELSE 0 END), 9) AS truncation_rate, round(sum(least(n_chars, cutoff)) / sum(n_chars), 9) AS retained, round(avg(least(n_chars, cutoff)), 6) AS mean_after
FROM documents, (SELECT unnest([512, 1024, 2048, 4096, 8192]) AS cutoff) GROUP BY source, cutoff""")
def cutoff_grid(t):
    out = A.cutoff_grid(t.documents, ["source"], "n_chars", [512, 1024, 2048, 4096, 8192])
    return out.withColumns({"truncation_rate": F.round("truncation_rate", 9), "retained": F.round("retained", 9), "mean_after": F.round("mean_after", 6)})


@query("""SELECT p_brand, p_size, round(median(ln(p_retailprice)), 9) AS logged, count(*) AS replicates, bool_and(p_type = 'ECONOMY') AS all_flagged, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS ids FROM part GROUP BY p_brand, p_size""")
def replicate_fold(t):
    rows = t.part.withColumn("logged", F.log("p_retailprice"))
    return A.replicate_fold(rows, ["p_brand", "p_size"], ["logged"], F.col("p_type") == "ECONOMY", "p_partkey").withColumn("logged", F.round("logged", 9))


@query("""SELECT round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS micro, count(*) AS groups FROM (SELECT avg(o_totalprice) AS m, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY o_custkey)""")
def macro_micro(t):
    return A.macro_micro(t.orders, "o_custkey", "o_totalprice").select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), "groups")


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, count(*) AS n0, median(o_totalprice) AS v0 FROM orders GROUP BY ALL), m AS (SELECT o_orderpriority, count(*) AS n1, median(o_totalprice) AS v1 FROM orders GROUP BY ALL),
p AS (SELECT count(*) AS n2, median(o_totalprice) AS v2 FROM orders) SELECT o_custkey, f.o_orderpriority, CASE WHEN n0 >= 4 THEN 0 WHEN n1 >= 4 THEN 1 ELSE 2 END AS level,
round(CASE WHEN n0 >= 4 THEN v0 WHEN n1 >= 4 THEN v1 ELSE v2 END, 3) AS value FROM f JOIN m ON f.o_orderpriority = m.o_orderpriority, p""")
def hierarchical_fallback(t):
    return A.fallback_levels(t.orders, "o_custkey", ["o_orderpriority"], "o_totalprice", 4).withColumn("value", F.round("value", 3))


@query("""WITH c AS (SELECT lang, count_if(toxic = 1) AS k, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang), q AS (SELECT lang, k, n, k / n AS p, 3.8414588206941254 AS z2, 1.959963984540054 AS z FROM c)
SELECT lang, k, n, round(greatest(0, ((p + z2 / (2 * n)) / (1 + z2 / n)) - z * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 8) AS low,
round(least(1, ((p + z2 / (2 * n)) / (1 + z2 / n)) + z * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 8) AS high FROM q""")
def wilson(t):
    per = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return per.select("lang", "k", "n", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query(f"""WITH {_STEPS}, p AS (SELECT job, step, sum(tokens) AS f, max(seconds) AS slow, min(seconds) AS fast, count(DISTINCT rank) AS ranks FROM rows GROUP BY job, step)
SELECT job, round(sum(f) / (sum(slow) * max(ranks) * 2.0), 12) AS mfu, round(avg((slow - fast) / slow), 9) AS straggler_gap, count(*) AS steps FROM p WHERE step > 1000 GROUP BY job""")
def step_utilisation(t):
    out = A.step_utilisation(_steps(t), "job", "step", "rank", "seconds", "tokens", 1000, 2.0)
    return out.select("job", F.round("mfu", 12).alias("mfu"), F.round("straggler_gap", 9).alias("straggler_gap"), "steps")


@query("""WITH r AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem)
SELECT l_suppkey, CASE WHEN pos < 5 THEN 'warmup' WHEN pos < 45 THEN 'measured' ELSE 'prefetched' END AS bucket, CAST(sum(q) AS BIGINT) AS tokens, count(*) AS batches FROM r GROUP BY ALL""")
def token_ledger(t):
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("long"))
    return A.token_ledger(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "q", 5, 40)


@query("""WITH p AS (SELECT p_brand, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) / avg(p_retailprice) AS cv, (max(p_retailprice) - min(p_retailprice)) / avg(p_retailprice) AS spread, count(DISTINCT p_type) = 1 AS consistent FROM part GROUP BY p_brand)
SELECT p.p_brand, round(p.mean, 9) AS mean, round(p.cv, 9) AS cv, round(p.spread, 9) AS spread, p.consistent, round((p.mean - b.mean) / b.mean, 9) AS delta FROM p, (SELECT mean FROM p WHERE p_brand = 'Brand#1') b""")
def run_comparison(t):
    out = A.run_comparison(t.part, "p_brand", "p_retailprice", "Brand#1", "p_type")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "cv", "spread", "delta")})


@query("""WITH u AS (SELECT o_custkey, o_orderpriority, o_orderstatus, max(o_totalprice) / min(o_totalprice) - 1 AS noise FROM orders GROUP BY ALL HAVING count(*) >= 2)
SELECT o_orderstatus, count(*) AS units, round(median(noise), 8) AS median, round(quantile_cont(noise, 0.9), 8) AS p90, round(max(noise), 6) AS most FROM u GROUP BY o_orderstatus""")
def repeat_noise(t):
    out = A.repeat_noise(t.orders, ["o_custkey", "o_orderpriority"], "o_orderstatus", "o_totalprice")
    return out.withColumns({"median": F.round("median", 8), "p90": F.round("p90", 8), "most": F.round("most", 6)})


@query("""SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS "F", count_if(o_orderstatus = 'O') AS "O", count_if(o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""")
def crosstab(t):
    return A.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT p_brand, p_type, p_size, CAST(grouping_id(p_brand, p_type, p_size) AS BIGINT) AS level, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size))""")
def marginal_sets(t):
    return A.marginals(t.part, [["p_brand"], ["p_type"], ["p_size"]], n=F.count("*"))


@query("""WITH e AS (SELECT o_custkey, o_orderpriority, count(*) AS n, median(o_totalprice) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, n, round(median, 3) AS median, least, most, round((most - least) / least, 8) AS spread, CASE WHEN n < 2 THEN 'too_few' WHEN (most - least) / least > 1.5 THEN 'too_noisy' ELSE 'usable' END AS reason FROM e""")
def endpoint_summary(t):
    out = A.endpoint_summary(t.orders, ["o_custkey", "o_orderpriority"], "o_totalprice", 2, 1.5)
    return out.withColumns({"median": F.round("median", 3), "spread": F.round("spread", 8)})


@query("""WITH p AS (SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderpriority) AS sizes FROM orders GROUP BY ALL)
SELECT o_custkey, count(*) AS stages, min(sizes) AS least_sizes, count(*) >= 2 AND min(sizes) >= 2 AS identifiable FROM p GROUP BY o_custkey""")
def identifiable_scenarios(t):
    return A.identifiable(t.orders, "o_custkey", "o_orderstatus", "o_orderpriority")


@query("""WITH c AS (SELECT p_brand, p_type, p_size, bool_or(p_retailprice > 1400) AS bad FROM part GROUP BY ALL), s AS (SELECT p_brand, p_type, max(CASE WHEN NOT bad THEN p_size END) AS max_safe, min(CASE WHEN bad THEN p_size END) AS min_unsafe FROM c GROUP BY ALL)
SELECT *, coalesce(min_unsafe < max_safe, false) AS violation FROM s""")
def safe_region(t):
    return A.safe_region(t.part, ["p_brand", "p_type"], "p_size", F.col("p_retailprice") > 1400)


@query("""WITH p AS (SELECT p_brand, avg(CASE WHEN p_retailprice <= 1500 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN p_retailprice <= 1500 THEN 1 ELSE 0 END) AS k, count(*) AS n, count_if(p_retailprice > 1800 AND p_size < 5) AS f FROM part GROUP BY p_brand)
SELECT round(sum(k) / sum(n), 9) AS coverage, round(quantile_cont(c, 0.05), 9) AS scenario_p05, CAST(sum(f) AS BIGINT) AS false_safe, count(*) AS scenarios, sum(k) / sum(n) >= 0.9 AND sum(f) = 0 AS passed FROM p""")
def memory_acceptance(t):
    out = A.acceptance(t.part, "p_brand", F.col("p_retailprice") <= 1500, (F.col("p_retailprice") > 1800) & (F.col("p_size") < 5), 0.9)
    return out.withColumns({"coverage": F.round("coverage", 9), "scenario_p05": F.round("scenario_p05", 9)})


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, quantile_cont(o_totalprice, 0.9) AS v FROM orders GROUP BY ALL)
SELECT o_custkey, n, CASE WHEN n < 5 THEN 'too_few' WHEN v > 450000 THEN 'implausible' ELSE 'ok' END AS reason, round(CASE WHEN n >= 5 AND v <= 450000 THEN v END, 3) AS guard FROM g""")
def order_guard(t):
    return A.order_guard(t.orders, ["o_custkey"], "o_totalprice", 0.9, 5, 450000).withColumn("guard", F.round("guard", 3))


@query("""SELECT l_orderkey, count(*) AS tensors, CAST(sum(l_quantity) AS BIGINT) AS parameters FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem) GROUP BY l_orderkey""")
def structure_counts(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("l_quantity"))
    return A.unique_structure(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], "l_quantity")


@query("""WITH w AS (SELECT source, n_chars, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents)
SELECT source, m AS batch, round(sum(n_chars * (pow(i / n, m) - pow((i - 1) / n, m))), 5) AS expected FROM w, (SELECT unnest([1, 2, 4, 8]) AS m) GROUP BY source, m""")
def expected_batch_max(t):
    return W.expected_batch_max(t.documents, ["source"], "n_chars", "doc_id", [1, 2, 4, 8]).withColumn("expected", F.round("expected", 5))


@query(f"""WITH {_REDUCED}, m AS (SELECT job, median(seconds) AS s, count(*) AS n FROM steps GROUP BY job)
SELECT c_nationkey, job AS best_job, round(s, 3) AS median_seconds, n AS runs FROM (SELECT c_nationkey, job, s, n, row_number() OVER (PARTITION BY c_nationkey ORDER BY s, job) AS k FROM m JOIN customer ON c_custkey = job) WHERE k = 1""")
def scenario_recommendation(t):
    """Flagship: ranks to steps, steps to jobs, and the job with the fastest steps of each scenario."""
    steps = A.rank_reduce(_steps(t), ["job", "step"], ["tokens"], ["seconds"], "warmup")
    jobs = steps.groupBy("job").agg(S.median("seconds").alias("s"), F.count("*").alias("runs"))
    rows = jobs.join(t.customer.select("c_custkey", "c_nationkey"), F.col("job") == F.col("c_custkey"))
    best = W.best_by(rows, ["c_nationkey"], [F.col("s"), F.col("job")])
    return best.select("c_nationkey", F.col("job").alias("best_job"), F.round("s", 3).alias("median_seconds"), "runs")




@query("""SELECT o_orderpriority, count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.05), 6) AS p05, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'all', count(o_totalprice), round(quantile_cont(o_totalprice, 0.05), 6), round(quantile_cont(o_totalprice, 0.5), 6), round(quantile_cont(o_totalprice, 0.99), 6) FROM orders""")
def sorted_percentiles(t):
    """Exact percentiles of large groups and of the whole table, found in rows that are sorted over all tasks."""
    shares = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    rounded = lambda df: df.select("o_orderpriority", F.col("_count").alias("n"), *(F.round(s, 6).alias(s) for s in shares))
    whole = percentiles(t.orders, [], "o_totalprice", shares).withColumn("o_orderpriority", F.lit("all"))
    return rounded(percentiles(t.orders, ["o_orderpriority"], "o_totalprice", shares)).unionByName(rounded(whole))
