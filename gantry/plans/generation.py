"""Queries over the generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import generators as G
from gantry.plans.base import query


def _requests(t):
    return t.part.select(
        F.col("p_partkey").alias("request"), F.when(F.col("p_partkey") % 2 == 0, "full").otherwise("lora").alias("mode"), (F.lit(32) * (1 + F.col("p_partkey") % 3)).cast("long").alias("batch"),
        (F.col("p_size") * 200).alias("cutoff"), (F.col("p_partkey") * 5_000_000 + 100_000_000).alias("parameters"),
    )


_REQ = "q AS (SELECT p_partkey AS request, CASE WHEN p_partkey % 2 = 0 THEN 'full' ELSE 'lora' END AS mode, 32 * (1 + p_partkey % 3) AS batch, p_size * 200 AS cutoff, p_partkey * 5000000 + 100000000 AS parameters FROM part)"
_CAND = f"""{_REQ}, g AS (SELECT *, unnest([1, 2, 4]) AS cards FROM q), z AS (SELECT *, unnest(CASE WHEN cards = 1 THEN [0] ELSE [2, 3] END) AS stage FROM g),
m AS (SELECT *, unnest(CASE WHEN cutoff <= 512 THEN [1, 2, 4, 8, 16, 32] WHEN cutoff <= 2048 THEN [1, 2, 4, 8, 16] WHEN cutoff <= 4096 THEN [1, 2, 4, 8] WHEN cutoff <= 8192 THEN [1, 2, 4] ELSE [1, 2] END) AS mbs FROM z),
c AS (SELECT *, unnest([true, false]) AS gc FROM m), f AS (SELECT *, CASE WHEN mode = 'full' THEN parameters ELSE greatest(1, CAST(floor(parameters * 0.01) AS BIGINT)) END AS tr FROM c),
s AS (SELECT *, CASE WHEN cards * mbs <= batch AND batch % (cards * mbs) = 0 THEN batch // (cards * mbs) END AS accumulation, CASE WHEN stage >= 3 THEN (parameters * 2) // cards + (tr * 12) // cards WHEN stage >= 1 THEN parameters * 2 + (tr * 12) // cards ELSE parameters * 2 + tr * 12 END AS floor_bytes FROM f),
k AS (SELECT *, CASE WHEN accumulation IS NULL THEN 'batch_not_divisible' WHEN floor_bytes > 76000000000 THEN 'state_exceeds_capacity' END AS reason FROM s)"""


@query(f"WITH {_CAND} SELECT request, cards, stage, mbs, gc, accumulation, floor_bytes, reason FROM k")
def candidate_grid(t):
    return G.candidates(_requests(t), 80_000_000_000).select("request", "cards", "stage", "mbs", "gc", "accumulation", "floor_bytes", "reason")


@query("SELECT n_nationkey, a AS alpha, b AS depth FROM nation, (SELECT unnest([0.1::DOUBLE, 1.0, 10.0]) AS a), (SELECT unnest([2, 4]) AS b)")
def parameter_grid(t):
    return G.grid(t.nation.select("n_nationkey"), {"alpha": [0.1, 1.0, 10.0], "depth": [2, 4]})


@query("""SELECT r_regionkey, cards, packing, kind FROM (SELECT r_regionkey, unnest([1, 2, 4]) AS cards, CAST(NULL AS BOOLEAN) AS packing, 'scaling' AS kind FROM region UNION ALL SELECT r_regionkey, NULL, unnest([true, false]), 'packing' FROM region)""")
def experiment_matrix(t):
    return G.matrix(t.region.select("r_regionkey"), {"scaling": {"cards": [1, 2, 4]}, "packing": {"packing": [True, False]}})


@query("""WITH b AS (SELECT o_custkey AS c_custkey, count(*) AS most FROM orders GROUP BY o_custkey), j AS (SELECT c.c_custkey, list_filter([1, 2, 4, 8, 16], lambda m: m <= coalesce(most, 1)) AS ok FROM customer c LEFT JOIN b ON c.c_custkey = b.c_custkey)
SELECT c_custkey, mbs, repeat FROM (SELECT c_custkey, unnest(list_slice(ok, greatest(1, len(ok) - 1), len(ok))) AS mbs FROM j), (SELECT unnest([1, 2]) AS repeat)""")
def job_materialisation(t):
    bounds = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("most"))
    requests = t.customer.select("c_custkey").withColumn("sizes", F.array(*map(F.lit, (1, 2, 4, 8, 16))))
    return G.jobs_from(requests, bounds, ["c_custkey"], "sizes", "most", 2, 2).select("c_custkey", "mbs", "repeat")


@query()
def greedy_knapsack(t):
    position = F.row_number().over(G.Window.partitionBy("source").orderBy("doc_id")) - 1
    return G.knapsack(t.documents.withColumn("pos", position), "source", "pos", "n_chars", 8192, 4)


@query()
def best_fit(t):
    return G.best_fit(t.documents, "source", "n_chars", [4096, 8192])


@query()
def packing_curve(t):
    return G.best_fit(t.documents, "lang", "n_chars", [2048, 4096, 8192, 16384])


@query("""WITH b AS (SELECT source, n_chars, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS b FROM documents), p AS (SELECT source, b, sum(n_chars) AS s, max(n_chars) * count(*) AS p FROM b GROUP BY ALL)
SELECT source, CAST(sum(s) AS BIGINT) AS real, CAST(sum(p) AS BIGINT) AS padded, round(sum(s) / sum(p), 9) AS utilisation FROM p GROUP BY source""")
def padding_fixed(t):
    return G.padding(t.documents, "source", ["doc_id"], "n_chars", 8).withColumn("utilisation", F.round("utilisation", 9))


@query()
def padding_shuffled(t):
    return G.shuffled_padding(t.documents, "source", "doc_id", "n_chars", 8, [1, 2, 3])


@query("""WITH j AS (SELECT p_partkey, CAST(pow(2, p_size % 3) AS INTEGER) AS cards FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY cards ORDER BY p_partkey) - 1 AS pos FROM j)
SELECT p_partkey, cards, pos // (8 // cards) AS wave, pos % (8 // cards) AS place, cards * (8 // cards) = 8 AS "full" FROM r""")
def wave_plan(t):
    jobs = t.part.select("p_partkey", F.pow(F.lit(2), F.col("p_size") % 3).cast("int").alias("cards"))
    return G.homogeneous_waves(jobs, "p_partkey", "cards", 8)


@query()
def mixed_wave_plan(t):
    jobs = t.part.select("p_brand", "p_partkey", F.pow(F.lit(2), F.col("p_size") % 3).cast("int").alias("cards"))
    return G.plan_waves(jobs, "p_brand", "p_partkey", "cards", 8)


@query()
def first_fit_waves(t):
    jobs = t.part.select("p_brand", "p_partkey", F.pow(F.lit(2), F.col("p_size") % 3).cast("int").alias("cards"))
    return G.preview_waves(jobs, "p_brand", "p_partkey", "cards", list(range(8)))


@query(f"""WITH {_CAND}, d AS (SELECT request, CASE WHEN request % 4 = 0 THEN 'on' ELSE 'off' END AS decision FROM q WHERE request % 2 = 0)
SELECT request, cards, stage, mbs, gc, false AS packing, 'off' AS branch FROM k UNION ALL SELECT k.request, cards, stage, mbs, gc, true, CASE WHEN decision = 'on' THEN 'on' ELSE 'shadow' END FROM k LEFT JOIN d ON k.request = d.request WHERE mbs = 1""")
def packing_branches(t):
    requests = _requests(t)
    decisions = requests.where("request % 2 = 0").select("request", F.when(F.col("request") % 4 == 0, "on").otherwise("off").alias("decision"))
    return G.packing_branches(requests, decisions, "request", 80_000_000_000).select("request", "cards", "stage", "mbs", "gc", "packing", "branch")
