"""Queries over filters, joins, sets, order and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import domains as D
from gantry.operators import relational as R
from gantry.plans.base import query


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND (CAST(o_orderkey AS VARCHAR) ILIKE '%11%' OR o_orderpriority ILIKE '%11%')""")
def filtered_listing(t):
    rows = R.matching(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None})
    return R.searching(rows, "11", ["o_orderkey", "o_orderpriority"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20""")
def priority_page(t):
    return R.page(R.priority_order(t.orders, "o_orderstatus", ["O", "P"], F.col("o_orderdate"), "o_orderkey"), 50, 20).select("o_orderkey", "o_orderstatus")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 23 = 0 AS nothing, lower(concat('fam', p_partkey % 5, CASE WHEN p_partkey % 5 = 4 THEN 'VL' ELSE '' END, ' ', p_type)) AS named,
CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 3 WHEN p_partkey % 29 = 0 THEN 0 WHEN p_size = 7 THEN 1 ELSE 4 END AS layers, CASE WHEN p_size > 10 THEN 4 WHEN p_size = 7 THEN 1 END AS kinds FROM part)
SELECT k AS p_partkey, array_to_string(list_filter([CASE WHEN nothing OR k % 7 = 0 OR k % 11 = 0 OR named LIKE '%vl%' OR named LIKE '%vision%' THEN 'vision_language_outside_supported_domain' END,
CASE WHEN nothing OR layers IS NULL OR layers <= 0 OR kinds <> layers OR k % 13 = 0 OR (s > 10 AND s % 3 = 0) OR s = 7 THEN 'hybrid_attention_outside_supported_domain' END], lambda x: x IS NOT NULL), ',') AS refusals FROM p""")
def architecture_refusals(t):
    """Every 23rd model has nothing that can be read, others no or a wrong number of layers."""
    key, size = F.col("p_partkey"), F.col("p_size")
    there = lambda c: F.when(key % 23 != 0, c)
    family = F.concat(F.lit("fam"), (key % 5).cast("string"), F.when(key % 5 == 4, "VL").otherwise(""))
    kinds = F.when(size > 10, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when((i == 2) & (size % 3 == 0), "linear_attention").otherwise("full_attention"))).when(size == 7, F.array(F.lit("odd_kind")))
    keys = F.array_compact(F.array(F.when(key % 11 == 0, F.lit("image_token_id")), F.when(key % 13 == 0, F.lit("full_attention_interval")), F.lit("hidden_size")))
    layers = F.when(key % 17 == 0, None).when(key % 19 == 0, 3).when(key % 29 == 0, 0).when(size == 7, 1).otherwise(4)
    refused = R.architecture_refusals(there(family), there(F.array("p_type")), there(kinds), there(key % 7 == 0), there(keys), there(layers))
    return t.part.select("p_partkey", F.array_join(refused, ",").alias("refusals"))


@query("""WITH a AS (SELECT c_custkey AS place, concat('j', c_custkey) AS job, concat('a', c_custkey % 7) AS attempt, 1000.0 * (c_custkey % 50) AS b, 1000.0 * (c_custkey % 50) + 200000 AS e FROM customer),
v AS (SELECT o_custkey AS place, o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS t, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('j', o_custkey + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END) END AS job, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat('a', o_custkey % 7) END AS attempt FROM orders)
SELECT v.place, count_if(t IS NULL) AS missing_time, count_if(t IS NOT NULL AND (t < b OR t > e)) AS outside_attempt, count_if(t BETWEEN b AND e AND (v.job = '' OR v.attempt IS NULL)) AS missing_binding,
count_if(t BETWEEN b AND e AND v.job <> '' AND v.attempt IS NOT NULL AND (v.job <> a.job OR v.attempt <> a.attempt)) AS mismatched_binding, count_if(t BETWEEN b AND e AND v.job = a.job AND v.attempt = a.attempt) AS in_attempt FROM v JOIN a ON v.place = a.place GROUP BY v.place""")
def attempt_binding(t):
    key = F.col("o_orderkey")
    attempts = t.customer.select(F.col("c_custkey").alias("place"), F.concat(F.lit("j"), F.col("c_custkey").cast("string")).alias("job"), F.concat(F.lit("a"), (F.col("c_custkey") % 7).cast("string")).alias("attempt"), (F.col("c_custkey") % 50 * 1000.0).alias("b"), (F.col("c_custkey") % 50 * 1000.0 + 200000).alias("e"))
    events = t.orders.select(
        F.col("o_custkey").alias("place"), F.when(key % 17 == 0, None).otherwise(F.col("o_totalprice")).alias("t"), F.when(key % 19 == 0, "").otherwise(F.concat(F.lit("j"), (F.col("o_custkey") + F.when(key % 23 == 0, 1).otherwise(0)).cast("string"))).alias("job"),
        F.when(key % 29 == 0, None).otherwise(F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string"))).alias("attempt"),
    )
    return R.binding_counts(events, attempts, "place", "job", "attempt", "t", "b", "e")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM orders""")
def disjoint_batches(t):
    keys = t.orders.select("o_orderkey")
    return R.disjoint_union({"even": keys.where("o_orderkey % 2 = 0"), "odd": keys.where("o_orderkey % 2 = 1")}, "o_orderkey")


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS admitted, CASE WHEN o_orderstatus = 'F' THEN c_acctbal END AS c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 > 0""")
def admission_join(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("request"), (F.col("o_orderstatus") == "F").alias("admitted"))
    predictions = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("request"), "c_acctbal")
    return R.with_predictions(rows, predictions, "request", "admitted", ["c_acctbal"]).select("o_orderkey", "admitted", "c_acctbal")


@query("""SELECT 'some' AS manifest, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) UNION ALL SELECT 'none', count(*) FROM orders""")
def manifest_scope(t):
    active = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    counted = lambda name, keys: R.scoped(t.orders.select("o_custkey"), keys, "o_custkey").agg(F.lit(name).alias("manifest"), F.count("*").alias("n"))
    return counted("some", active.where("c_acctbal > 5000")).unionByName(counted("none", active.where("c_acctbal > 1e9")))


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def counted_page(t):
    return R.counted_page(t.orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25, 50).select("o_orderkey", "total")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY coalesce(CASE WHEN p_size > 10 THEN p_brand END, ''), coalesce(CASE WHEN p_size < 40 THEN p_size END, 0), p_partkey) AS place FROM part""")
def report_order(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("b"), F.when(F.col("p_size") < 40, F.col("p_size")).alias("s"))
    kept = R.report_order(rows, ["b", "s", "p_partkey"])
    return kept.select("p_partkey", F.row_number().over(R.Window.orderBy(F.coalesce("b", F.lit("")), F.coalesce("s", F.lit(0)), "p_partkey")).cast("long").alias("place"))  # a page for people


@query()
def reservoir_sample(t):
    return R.reservoir(t.part.select("p_partkey", "p_brand"), "p_partkey", 50, 7)


@query("""SELECT event_id, user_id, hour, gpu FROM (SELECT event_id, user_id, date_trunc('hour', ts) AS hour, event_id % 2 AS gpu, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts), event_id % 2 ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def telemetry_replace(t):
    rows = t.events.select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), (F.col("event_id") % 2).alias("gpu"), "ts")
    return R.last_wins(rows, ["user_id", "hour", "gpu"], ["ts", "event_id"]).select("event_id", "user_id", "hour", "gpu")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def keys_by_status(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").distinct()


#: Twelve fields that say which run a row is.
_IDENTITY = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "size", "repeat"]


@query("""WITH r AS (SELECT concat(l_orderkey, '-', l_linenumber) AS job, hash_of, kind FROM (SELECT *, (l_orderkey * 7 + l_linenumber) % 29 AS hash_of, CASE WHEN l_orderkey % 3 = 0 THEN 'screen' ELSE 'formal' END AS kind FROM lineitem)),
n AS (SELECT job, count(*) AS n FROM r GROUP BY job)
SELECT r.job FROM r JOIN n USING (job) WHERE n.n = 1 AND kind = 'formal' AND hash_of NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)""")
def active_results(t):
    """Plans that differ from their results in one of the twelve fields, are there twice, are of another kind or have no id."""
    rows = t.lineitem.withColumns({
        "job": F.concat("l_orderkey", F.lit("-"), "l_linenumber"), "kind": F.when(F.col("l_orderkey") % 3 == 0, "screen").otherwise("formal"), "size": F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linenumber")),
        "repeat": (F.col("l_orderkey") % 4).cast("int"), "h": (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 29,
    })
    other = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast(rows.schema[c].dataType)) if c == "size" else F.lit(None).cast(rows.schema[c].dataType)
    plan = rows.select("h", F.when(F.col("h") != 13, F.col("job")).alias("job"), F.when(F.col("h") == 12, "screen").otherwise(F.col("kind")).alias("kind"), *(F.when(F.col("h") == i, other(c)).otherwise(F.col(c)).alias(c) for i, c in enumerate(_IDENTITY)))
    plan = plan.unionByName(plan.where("h = 14")).drop("h")
    return R.active_results(rows, plan, "job", _IDENTITY, "kind", "formal").select("job")


def _domain(t):
    """Sizes as a grid against a range, brands as two lists, types of one component alone."""
    size, brand = F.col("p_size"), F.col("p_brand")
    one = lambda rows, component, dimension, value, number: rows.select(F.lit(component).alias("component"), F.lit(dimension).alias("dimension"), value.cast("string").alias("value"), number.cast("double").alias("number"), *(F.lit(None).cast("double").alias(c) for c in ("low", "high"))).distinct()
    none = F.lit(None)
    bounds = t.part.agg(F.min(size).alias("a"), F.max(size).alias("b")).select(F.lit("packing").alias("component"), F.lit("p_size").alias("dimension"), none.cast("string").alias("value"), none.cast("double").alias("number"), (F.col("a") + 3).cast("double").alias("low"), (F.col("b") - 9).cast("double").alias("high"))
    parts = [one(t.part.where("p_size % 2 = 0"), "ranking", "p_size", size, size), bounds, one(t.part.where("p_brand < 'Brand#4'"), "ranking", "p_brand", brand, none), one(t.part.where("p_brand > 'Brand#2'"), "packing", "p_brand", brand, none), one(t.part, "ranking", "p_type", F.col("p_type"), none)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_DOMAIN_SQL = """b AS (SELECT min(p_size) + 3 AS lo, max(p_size) - 9 AS hi FROM part),
s AS (SELECT DISTINCT p_size AS v FROM part WHERE p_size % 2 = 0), r AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand < 'Brand#4'), k AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand > 'Brand#2')"""


@query(f"""WITH {_DOMAIN_SQL}
SELECT 'p_size' AS dimension, true AS constrained, (SELECT string_agg(v, ',' ORDER BY v) FROM s, b WHERE v BETWEEN lo AND hi) AS agree_on, (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM s, b WHERE v > hi) AS first_only, '' AS second_only, (SELECT CASE WHEN hi IN (SELECT v FROM s) THEN '' ELSE CAST(hi AS VARCHAR) END FROM b) AS boundary_absent, true AS conflict
UNION ALL SELECT 'p_brand', true, (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM r WHERE v IN (SELECT v FROM k)), (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM r WHERE v NOT IN (SELECT v FROM k)), (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM k WHERE v NOT IN (SELECT v FROM r)), '', true
UNION ALL SELECT 'p_type', false, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT p_type AS v FROM part)), '', '', '', false""")
def domain_reconciliation(t):
    rows = D.reconcile(_domain(t), "ranking", "packing")
    return rows.select("dimension", "constrained", *(F.array_join(c, ",").alias(c) for c in ("agree_on", "first_only", "second_only", "boundary_absent")), "conflict")


@query(f"""WITH {_DOMAIN_SQL}, f AS (SELECT p_partkey, p_size IN (SELECT v FROM s) AND p_brand IN (SELECT v FROM r) AS a, p_size IN (SELECT v FROM s) AND p_size BETWEEN (SELECT lo FROM b) AND (SELECT hi FROM b) AND p_brand IN (SELECT v FROM r) AND p_brand IN (SELECT v FROM k) AS b FROM part)
SELECT p_partkey, a AS first_available, b AS second_available, CASE WHEN a AND b THEN 'strong' WHEN a OR b THEN 'weak' ELSE 'outside' END AS support, concat_ws(',', CASE WHEN NOT a THEN 'outside_predictor_support_grid' END, CASE WHEN NOT b THEN 'outside_packing_release_domain' END) AS reasons FROM f""")
def request_support(t):
    told = D.reconcile(_domain(t), "ranking", "packing")
    rows = D.classify(t.part.select("p_partkey", "p_size", "p_brand", "p_type"), told, ["p_size", "p_brand"], ["p_size", "p_brand", "p_type"])
    return rows.select("p_partkey", "first_available", "second_available", "support", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT count_if(n_chars < 100) AS short, count_if(lang <> 'en') AS foreign_text, count_if(text LIKE '%###%') AS symbols, count_if(NOT (n_chars < 100 OR lang <> 'en' OR text LIKE '%###%')) AS kept FROM documents""")
def quality_drop_counts(t):
    return R.drop_counts(t.documents, {"short": F.col("n_chars") < 100, "foreign_text": F.col("lang") != "en", "symbols": F.col("text").contains("###")})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000)")
def length_range_filter(t):
    lengths = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return R.in_length_range(t.lineitem, lengths, "l_orderkey", "o_totalprice", 100000, 200000).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT p_partkey, mbs FROM (SELECT p_partkey, p_size, 1 + p_partkey % 4 AS cards, 64 * (1 + p_partkey % 3) AS batch FROM part), (SELECT unnest([1, 2, 4, 8, 16]) AS mbs) WHERE batch % (cards * mbs) = 0 AND mbs <= p_size""")
def compatible_sizes(t):
    rows = t.part.select("p_partkey", "p_size", (F.col("p_partkey") % 4 + 1).alias("cards"), (F.col("p_partkey") % 3 * 64 + 64).alias("batch"))
    return R.compatible_sizes(rows, [1, 2, 4, 8, 16], "cards", "batch", "p_size").select("p_partkey", "mbs")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD') THEN 'type' END, CASE WHEN p_retailprice > 950 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM part""")
def scope_mismatches(t):
    tests = {"size": F.col("p_size") > 40, "type": ~F.col("p_type").isin("ECONOMY", "STANDARD"), "price": F.col("p_retailprice") > 950}
    return t.part.select("p_partkey", F.array_join(R.reasons(tests), ",").alias("mismatches"))


@query("""SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'accepted' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'active' ELSE 'pending' END AS outcome, count(*) AS n FROM customer GROUP BY 1""")
def queue_partition(t):
    jobs, on = t.customer.select(F.col("c_custkey").alias("job")), t.orders.select(F.col("o_custkey").alias("job"), "o_orderstatus")
    return R.partition_queue(jobs, on, on.where("o_orderstatus = 'F'"), "job").groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN 1706000000 - epoch_us(ts) / 1e6 <= 600000 THEN 'running' ELSE 'interrupted' END AS status FROM events""")
def attempt_freshness(t):
    rows = t.events.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("modified"))
    return R.freshness(rows, "modified", F.lit(1706000000), 600000).select("event_id", "status")


@query("""SELECT event_id, user_id, event_type, ts FROM (SELECT *, rank() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1""")
def latest_per_gpu(t):
    return R.latest_per(t.events, ["event_type", "user_id"], "ts").select("event_id", "user_id", "event_type", "ts")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL), f AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT coalesce(f.o_custkey, s.o_custkey) AS o_custkey, coalesce(f.o_orderpriority, s.o_orderpriority) AS o_orderpriority, coalesce(f.v, s.v) AS v, CASE WHEN f.v IS NOT NULL THEN 'formal' ELSE 'screen' END AS stage
FROM f FULL JOIN s ON f.o_custkey = s.o_custkey AND f.o_orderpriority = s.o_orderpriority""")
def screen_formal_outer(t):
    best = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("v"))
    return R.preferred(best("F"), best("O"), ["o_custkey", "o_orderpriority"], ["v"])


_PAIRS = """p AS (SELECT o_custkey, o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS off, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS on_ FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, o_orderpriority, off, on_, (1 / off - 1 / on_) * off AS gain, on_ / off AS ratio FROM p WHERE off > 0 AND on_ > 0)"""


@query(f'WITH {_PAIRS} SELECT o_custkey, o_orderpriority, off, on_ AS "on", round(gain, 8) AS gain, round(ratio, 7) AS ratio FROM g')
def paired_effect(t):
    out = R.paired(t.orders, ["o_custkey", "o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice")
    return out.withColumns({"gain": F.round("gain", 8), "ratio": F.round("ratio", 7)})


@query(f"""WITH {_PAIRS} SELECT o_custkey, count(*) AS pairs, round(min(gain), 8) AS worst, round(median(gain), 8) AS median, round(max(gain), 8) AS best, CASE WHEN min(gain) >= 0.1 THEN 'on' ELSE 'off' END AS decision FROM g GROUP BY o_custkey""")
def packing_decisions(t):
    pairs = R.paired(t.orders, ["o_custkey", "o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice")
    return R.packing_decision(pairs, ["o_custkey"], F.lit(0.1)).withColumns({c: F.round(c, 8) for c in ("worst", "median", "best")})


@query("""WITH f AS (SELECT o_custkey, max(o_orderkey) AS top FROM orders GROUP BY o_custkey) SELECT f.o_custkey, top, o.o_totalprice AS trial FROM f LEFT JOIN orders o
ON concat(CAST(f.o_custkey AS VARCHAR), '-', CAST(top AS VARCHAR)) = concat(CAST(o.o_custkey AS VARCHAR), '-', CAST(o.o_orderkey AS VARCHAR)) AND o.o_orderstatus = 'F'""")
def family_left_join(t):
    top = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top")).withColumn("k", F.concat_ws("-", "o_custkey", "top"))
    trial = t.orders.where("o_orderstatus = 'F'").select(F.concat_ws("-", "o_custkey", "o_orderkey").alias("k"), F.col("o_totalprice").alias("trial"))
    return top.join(trial, "k", "left").drop("k")


@query("SELECT c_custkey, count(o_orderkey) AS results FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def plan_left_join(t):
    runs = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("results"))
    return t.customer.select("c_custkey").join(runs, "c_custkey", "left").na.fill(0, ["results"])


@query("""SELECT count(*) AS joined, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS missing FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def prediction_outcome_join(t):
    keys = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    joined = t.lineitem.select("l_orderkey").join(keys.withColumn("_hit", F.lit(1)), "l_orderkey", "left")
    return joined.agg(F.count("_hit").alias("joined"), F.count_if(F.col("_hit").isNull()).alias("missing"))


@query("""WITH a AS (SELECT user_id, min(ts) + INTERVAL 2 DAY AS b, max(ts) - INTERVAL 2 DAY AS e FROM events GROUP BY user_id) SELECT event_id, events.user_id FROM events JOIN a ON events.user_id = a.user_id AND ts BETWEEN b AND e""")
def attempt_interval_join(t):
    attempts = t.events.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 2 DAYS")).alias("b"), (F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("e"))
    return R.within_attempt(t.events, attempts, "user_id", "ts", "b", "e").select("event_id", "user_id")


@query("""WITH r AS (SELECT s_suppkey, s_nationkey AS nation, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'BUILDING' END AS seg FROM supplier) SELECT s_suppkey, c_custkey FROM r JOIN customer ON nation = c_nationkey AND (seg IS NULL OR seg = c_mktsegment)""")
def wildcard_theta_join(t):
    requests = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'BUILDING' END").alias("seg"))
    families = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"))
    return R.wildcard_match(requests, families, ["nation"], ["seg"]).select("s_suppkey", "c_custkey")


@query("""SELECT p.p_partkey, a.p_partkey AS anchor FROM part p JOIN part a ON p.p_brand = a.p_brand AND p.p_type = a.p_type AND p.p_size <= a.p_size AND p.p_retailprice <= a.p_retailprice""")
def dominance_join_all(t):
    """Every part as an anchor of those that it dominates."""
    cols = ["p_brand", "p_type", "p_size", "p_retailprice"]
    anchors = t.part.select(F.col("p_partkey").alias("anchor"), *cols)
    return R.dominated_by(t.part.select("p_partkey", *cols), anchors, cols[:2], cols[2:]).select("p_partkey", "anchor")


@query("""WITH p AS (SELECT p_brand, p_size AS cards, avg(p_retailprice) AS v FROM part GROUP BY ALL) SELECT a.p_brand, a.cards, round(b.v / a.v, 9) AS ratio FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.cards = 2 * a.cards""")
def doubling_self_join(t):
    points = t.part.groupBy("p_brand", F.col("p_size").alias("cards")).agg(F.avg("p_retailprice").alias("v"))
    return R.doublings(points, ["p_brand"], "cards", "v").select("p_brand", "cards", F.round("ratio", 9).alias("ratio"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_scenarios(t):
    good = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.unmatched(t.customer.select("c_custkey"), good, ["c_custkey"])


@query("""WITH a AS (SELECT l_suppkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_suppkey), p AS (SELECT l_suppkey, l_partkey % 50 AS step, count(DISTINCT l_linenumber) AS ranks FROM lineitem GROUP BY ALL)
SELECT p.l_suppkey, step, ranks FROM p JOIN a ON p.l_suppkey = a.l_suppkey WHERE ranks = n""")
def rank_intersection(t):
    rows = t.lineitem.select("l_suppkey", (F.col("l_partkey") % 50).alias("step"), "l_linenumber")
    return R.in_all_ranks(rows, ["l_suppkey"], "step", "l_linenumber")


@query("""WITH RECURSIVE b AS (SELECT p_brand, p_size AS o, CAST(avg(p_retailprice) AS DOUBLE) AS v FROM part GROUP BY ALL), w AS (
SELECT 0 AS i, p_brand, CAST(NULL AS DOUBLE) AS target, CAST(NULL AS INTEGER) AS o, CAST([] AS INTEGER[]) AS used FROM (SELECT DISTINCT p_brand FROM b)
UNION ALL SELECT i + 1, w.p_brand, [910.0, 950.0, 990.0][i + 1], (SELECT arg_min(b.o, struct_pack(d := abs(b.v - [910.0, 950.0, 990.0][i + 1]), o := b.o)) FROM b WHERE b.p_brand = w.p_brand AND NOT list_contains(w.used, b.o)),
list_append(w.used, (SELECT arg_min(b.o, struct_pack(d := abs(b.v - [910.0, 950.0, 990.0][i + 1]), o := b.o)) FROM b WHERE b.p_brand = w.p_brand AND NOT list_contains(w.used, b.o))) FROM w WHERE i < 3)
SELECT p_brand, target, o AS p_size FROM w WHERE i > 0""")
def nearest_unused(t):
    points = t.part.groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    return R.nearest_unused([910.0, 950.0, 990.0], points, ["p_brand"], "p_size", "v")


@query("""WITH s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT (SELECT count(*) FROM (SELECT * FROM s UNION SELECT * FROM f)) AS "all", (SELECT count(*) FROM s) AS screened, (SELECT count(*) FROM f) AS confirmed, (SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM f)) AS shared, (SELECT count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM f)) AS waiting""")
def progress_sets(t):
    return R.progress_sets(t.orders.where("o_orderstatus = 'O'"), t.orders.where("o_orderstatus = 'F'"), ["o_custkey"])


@query("""SELECT 'customer' AS origin, c_custkey AS k, c_acctbal AS bal, CAST(NULL AS DOUBLE) AS price FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, NULL, p_retailprice FROM part""")
def union_registry(t):
    return R.tagged_union({
        "customer": t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "supplier": t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")),
        "part": t.part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price")),
    })


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def union_dedup(t):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return R.first_by(t.lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) < 1997 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 1997)")
def fold_leakage(t):
    return R.overlap_size(t.orders.where("year(o_orderdate) < 1997"), t.orders.where("year(o_orderdate) >= 1997"), ["o_custkey"])


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_revision(t):
    return R.first_by(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT event_id, ts FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) ORDER BY ts, event_id")
def last_events(t):
    return R.last_then_ascending(t.events.select("event_id", "ts"), "ts", "event_id", 100)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, max(l_orderkey) OVER (PARTITION BY l_suppkey) AS top FROM lineitem) WHERE l_orderkey >= greatest(0, top - 200)")
def last_n_steps(t):
    return R.last_steps(t.lineitem, "l_suppkey", "l_orderkey", 200).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part), w AS (SELECT *, unnest(range(0, 7)) AS j FROM r)
SELECT DISTINCT p_brand, p_partkey FROM w WHERE i = CAST(round_even(j * (n - 1) / 6, 0) AS BIGINT)""")
def spread_selection(t):
    return R.spread_indices(t.part, ["p_brand"], ["p_retailprice", "p_partkey"], 7).select("p_brand", "p_partkey")


@query()
def seeded_sample(t):
    return R.keyed_sample(t.part.select("p_partkey", "p_brand"), "p_partkey", 50, 7, always=F.col("p_partkey") == 0)


@query("""WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v, 'done' AS s FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey > 14000), o AS (SELECT o_orderkey AS k, o_custkey * 1.0 AS v, CASE WHEN o_orderstatus = 'O' THEN 'planned' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey <= 14000)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.k IS NOT NULL AND o.s <> 'planned' THEN o.s ELSE coalesce(n.s, o.s) END AS s FROM o FULL JOIN n ON o.k = n.k""")
def upsert_coalesce(t):
    new = t.orders.where("o_orderkey % 2 = 0 OR o_orderkey > 14000").select(F.col("o_orderkey").alias("k"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END").alias("v"), F.lit("done").alias("s"))
    old = t.orders.where("o_orderkey <= 14000").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("double").alias("v"), F.expr("CASE WHEN o_orderstatus = 'O' THEN 'planned' ELSE o_orderstatus END").alias("s"))
    return R.upsert(old, new, ["k"], "s")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1""")
def last_wins(t):
    return R.last_wins(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT props, event_id FROM (SELECT *, row_number() OVER (PARTITION BY props ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def first_wins(t):
    return R.first_wins(t.events, ["props"], ["ts", "event_id"]).select("props", "event_id")


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND coalesce(value, 0) <= 100 THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE event_type END AS status FROM events""")
def close_stale(t):
    rows = t.events.select("event_id", F.expr("CASE WHEN event_type = 'click' THEN 'running' ELSE event_type END").alias("status"), "value")
    return R.close_stale(rows, "status", "value", F.lit(100)).select("event_id", "status")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def prune_anti(t):
    live = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")).join(t.orders, "o_custkey").select("o_orderkey")
    return R.prune(t.orders.select("o_orderkey", "o_orderstatus"), live, "o_orderkey", "o_orderstatus", "O").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def guarded_update(t):
    updates = t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return R.guarded_update(t.orders.select("o_orderkey", "o_orderstatus"), updates, "o_orderkey", "o_orderstatus", "P").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey % 10 = 3 ORDER BY o_orderdate DESC, o_orderkey""")
def filtered_scan(t):
    """All rows of the filters that are set, the newest first."""
    rows = t.orders.withColumn("campaign", F.col("o_custkey") % 10)
    return R.matching(rows, {"o_orderpriority": "2-HIGH", "o_orderstatus": None, "campaign": 3}).orderBy(F.col("o_orderdate").desc(), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("""SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 40""")
def recent_events(t):
    """The newest events of a log, newest first."""
    return R.page(t.events.where("event_type IN ('error', 'purchase')").orderBy(F.col("ts").desc(), F.col("event_id").desc()), 40, 0).select("event_id", "event_type")
