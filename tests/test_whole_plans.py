"""Queries and operators over all rows: no subset of ids, no first rows, no local optimum."""

from __future__ import annotations

import collections
import itertools

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from gantry.operators import generators as G
from gantry.operators import models as M
from gantry.operators import relational as R
from gantry.plans import aggregation, base, catalog, statistics

QUERIES = catalog.queries()


def test_every_job_has_a_wave(spark, sf):
    waves = QUERIES["mixed_wave_plan"](spark, sf).collect()
    assert sorted(int(r["job"]) for r in waves) == sorted(r["p_partkey"] for r in spark.read.parquet(f"{sf}/part.parquet").collect())


def test_every_part_is_an_anchor(spark, tmp_path):
    rows = [(1, "a", "t", 5, 10.0), (2, "a", "t", 6, 10.0), (3, "a", "t", 6, 9.0), (4, "a", "u", 9, 99.0), (40, "b", "t", 9, 99.0)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in QUERIES["dominance_join_all"](spark, str(tmp_path)).collect())
    assert got == [(1, 1), (1, 2), (2, 2), (3, 2), (3, 3), (4, 4), (40, 40)]


@pytest.mark.parametrize("seed", range(6))
def test_design_is_exact_beyond_the_limit(seed):
    x = np.random.default_rng(seed).normal(size=(24, 3))
    x[7] = x[3]  # a tie
    score = lambda rows: np.linalg.slogdet(np.eye(3) + x[list(rows)].T @ x[list(rows)])[1]
    brute = max(itertools.combinations(range(24), 4), key=lambda rows: (round(score(rows), 12), tuple(-r for r in rows)))
    assert M.determinant_design(x, 4, most=1) == brute


def test_design_weighs_all_candidates(spark, sf):
    d = statistics._candidates(base.Tables(spark, sf))
    x = np.column_stack([d["x"] / 50, d["c"] / 8, (d["x"] / 50) ** 2])
    score = lambda rows: np.linalg.slogdet(np.eye(3) + x[rows].T @ x[rows])[1]
    chosen = [r["row"] for r in QUERIES["optimal_design"](spark, sf).collect()]
    assert len(d) > 40 and score(chosen) > score(list(M.determinant_design(x[:40], 4))) + 1e-9


def test_scan_goes_beyond_31_candidates(spark, tmp_path):
    spark.createDataFrame([(7, 49, 500.0), (1, 1, 1000.0)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert tuple(QUERIES["multiplier_scan_301"](spark, str(tmp_path)).first()) == (2.21, 0, 1.0)


def test_binding_that_no_event_can_tell(spark, tmp_path):
    """A place whose events all lack what a state asks for; an order without a key; a name that is missing beside one that differs."""
    spark.createDataFrame([(k,) for k in range(1, 7)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(17, 1, 5000.0), (34, 2, 5000.0), (35, 2, 5000.0), (29, 3, 5000.0), (None, 4, 5000.0), (17 * 29, 5, 5000.0), (23 * 29, 6, 9000.0), (17 * 19, 6, 9000.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duck(str(tmp_path))
    for name in ("customer", "orders"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert not differences(QUERIES["attempt_binding"](spark, str(tmp_path)), con, catalog.oracle_sql()["attempt_binding"])


def test_large_keys_are_cut_into_tiles(spark, monkeypatch):
    """One key of many rows is shared by tasks; open fields, nulls on both sides and copies of rows pair as the conditions say."""
    monkeypatch.setattr(R, "TILE", 8)
    monkeypatch.setattr(R, "PAIRS", 64)
    rng = np.random.default_rng(5)
    pick = lambda options: [options[i] for i in rng.integers(0, len(options), 60)]
    asked, offered = (list(zip(range(60), pick(["n", "n", "n", "m", None]), pick(["s", "t", None]), pick(["x", None]), strict=True)) for _ in range(2))
    offered += offered[:5]
    fits = lambda q, f: q[1] is not None and q[1] == f[1] and all(a is None or a == b for a, b in zip(q[2:], f[2:], strict=True))
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, nation string, seg string, kind string")
    got = R.wildcard_match(df(asked, "q"), df(offered, "f"), ["nation"], ["seg", "kind"])
    assert sorted(tuple(r) for r in got.select("q", "f").collect()) == sorted((q[0], f[0]) for q in asked for f in offered if fits(q, f))
    points = list(zip(range(60), pick(["n", "n", "m", None]), pick([1, 2, 3, None]), pick([1, 2, 3]), strict=True))
    df = lambda k: spark.createDataFrame(points, f"{k} long, g string, x long, y long")
    got = R.dominated_by(df("c"), df("a"), ["g"], ["x", "y"])
    want = sorted((c[0], a[0]) for c in points for a in points if None not in (*c, *a) and c[1] == a[1] and c[2] <= a[2] and c[3] <= a[3])
    assert sorted(tuple(r) for r in got.select("c", "a").collect()) == want
    per_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < len(want) / 4


def test_pairs_are_not_rows_of_the_join(spark):
    """Rows that the join itself makes are blocks: far fewer than the pairs that are told apart or returned."""
    points = spark.range(3000).selectExpr("id AS a", "'n' AS g", "id % 50 AS x", "(id * 7919) % 1000 AS y")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = R.dominated_by(points.withColumnRenamed("a", "c"), points, ["g"], ["x", "y"]).select("c", "a")
        pairs = len(got.collect())
        todo, joined = [got._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName() == "SortMergeJoin":
                joined.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    x, y = (np.array([f(i) for i in range(3000)]) for f in (lambda i: i % 50, lambda i: i * 7919 % 1000))
    assert pairs == int(((x[:, None] <= x) & (y[:, None] <= y)).sum())
    assert 0 < joined[0] < pairs / 32


def test_blocks_hold_the_same_pairs(spark, monkeypatch):
    """Small tiles and blocks, one to three columns, ties, nulls, copies of rows, zeros of both signs and NaN (above all, as in SQL)."""
    monkeypatch.setattr(R, "TILE", 16)
    monkeypatch.setattr(R, "BLOCK", 8)
    rng = np.random.default_rng(11)
    pick = lambda options: [options[i] for i in rng.integers(0, len(options), 150)]
    sides = [list(zip(range(150), pick(["n", "n", "m", None]), pick([-0.0, 0.0, 1.5, 2.5, float("nan"), None]), pick(list(range(40))), pick([1, 2]), strict=True)) for _ in range(2)]
    sides[1] += sides[1][:9]
    left, right = (spark.createDataFrame(rows, f"{k} long, g string, x double, y long, z long") for k, rows in zip("ca", sides, strict=True))
    below = lambda a, b: b != b or a <= b
    for at_most in (["x"], ["y", "x"], ["z", "x", "y"]):
        at = ["xyz".index(n) + 2 for n in at_most]
        want = sorted((c[0], a[0]) for c in sides[0] for a in sides[1] if None not in (*c, *a) and c[1] == a[1] and all(below(c[i], a[i]) for i in at))
        got = R.dominated_by(left, right, ["g"], at_most).select("c", "a")
        assert sorted(tuple(r) for r in got.collect()) == want
    assert R.dominated_by(left, right.limit(0), ["g"], ["x"]).count() == 0


def test_pairs_take_little_room(spark, tmp_path):
    """Each left row of a block repeats the same right rows: stored pairs take far less than the bits that tell rows apart."""
    points = spark.range(3000).selectExpr("id AS a", "'n' AS g", "id % 50 AS x", "(id * 7919) % 1000 AS y")
    R.dominated_by(points.withColumnRenamed("a", "c"), points, ["g"], ["x", "y"]).select("c", "a").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs").count()
    stored = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert pairs > 2_000_000 and stored < 0.3 * pairs


def _waves_one_by_one(sizes, total):
    """Partial waves as they are told: each takes the first jobs that sum to the total, or to the most there is."""
    left, waves = sorted(sizes, key=lambda x: (-x[1], x[0])), []
    while left:
        best = {0: []}
        for i, (_, n) in enumerate(left):
            for s in sorted(best, reverse=True):
                if s + n <= total and total not in best:
                    best.setdefault(s + n, [*best[s], i])
        pick = best[max(best)] or [0]
        waves.append([left[i][0] for i in pick])
        left = [x for i, x in enumerate(left) if i not in pick]
    return waves


@pytest.mark.parametrize("seed", range(20))
def test_runs_of_waves_are_the_waves(seed):
    rng = np.random.default_rng(seed)
    total = int(rng.integers(3, 17))
    jobs = [(f"j{i}", int(n)) for i, n in enumerate(rng.choice(rng.integers(1, total + 3, 4), rng.integers(1, 90)))]
    assert G.mixed_waves(jobs, total, "partial") == _waves_one_by_one(jobs, total)
    counts = collections.Counter(n for _, n in jobs if n <= total)
    flat = [[m for masks in run.values() for m in masks] for _, times, run in G.first_fit_runs(counts, range(total)) for _ in range(times)]
    small = [j for j in jobs if j[1] <= total]
    assert flat == [[m for _, m in wave] for wave in G.first_fit_masks(small, range(total))]


def test_waves_follow_counts_not_jobs(spark):
    """Runs of a hundred million jobs, and queues of both kinds against waves that are made one by one."""
    assert len(G.mixed_runs({4: 10**8, 2: 10**8, 1: 10**8}, 8, "partial")) < 20
    assert len(G.first_fit_runs({4: 10**8, 2: 10**8, 1: 10**8}, range(8))) < 20
    rng = np.random.default_rng(3)
    queues = {q: [(i, int(n)) for i, n in enumerate(rng.choice([1, 2, 4], 150))] for q in ("a", "b")}
    jobs = spark.createDataFrame([(q, i, n) for q, rows in queues.items() for i, n in rows], "q string, job long, cards int")
    got = sorted(tuple(r) for r in G.plan_waves(jobs, "q", "job", "cards", 8).collect())
    assert got == sorted((q, k, j) for q, rows in queues.items() for k, w in enumerate(_waves_one_by_one([(str(i), n) for i, n in rows], 8)) for j in w)
    got = sorted(tuple(r) for r in G.preview_waves(jobs, "q", "job", "cards", list(range(8))).collect())
    assert got == sorted((q, k, str(j), ",".join(map(str, m))) for q, rows in queues.items() for k, w in enumerate(G.first_fit_masks(rows, list(range(8)))) for j, m in w)


def test_tasks_of_steps_follow_the_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(aggregation, "_LINES", 100)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert aggregation._steps(base.Tables(spark, sf)).rdd.getNumPartitions() == -(-lines // 100)
