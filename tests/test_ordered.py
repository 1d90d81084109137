"""Order statistics and pair counts over ranges, against plain ones; several ranges whatever the size."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gantry.operators import media, ordered


@pytest.fixture
def many_ranges(spark):
    """Ranges stay apart though they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, n, seed):
    r = random.Random(seed)
    group = lambda: r.choice(["hot"] * 6 + ["b", "c", None])
    value = lambda: r.choice([None, 1.0, 1.0, 2.0, r.randrange(40) / 4, r.gauss(0, 1)])
    rows = [(group(), r.choice([1, 2, None]), value(), value()) for _ in range(n)]
    return rows, spark.createDataFrame([*rows, ("nulls", 1, None, 1.0)], "g string, h int, x double, y double").repartition(5)


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
def test_percentiles_equal_numpy(many_ranges, keys):
    rows, df = table(many_ranges, 600, 1)
    shares = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {tuple(r[k] for k in keys): (r["_count"], *(r[s] for s in shares)) for r in ordered.percentiles(df, keys, "x", shares).collect()}
    want = {}
    for g, h, x, _ in rows:
        if x is not None:
            want.setdefault(tuple({"g": g, "h": h}[k] for k in keys), []).append(x)
    assert got.keys() == want.keys()
    for k, xs in want.items():
        assert got[k] == pytest.approx((len(xs), *np.quantile(xs, list(shares.values()))), rel=1e-12)
    one = df.where("x = 1").groupBy().agg(F.count("*")).first()[0]
    assert ordered.percentiles(df.where("x = 1"), [], "x", {"m": 0.3}).collect() == [(one, 1.0)]
    assert ordered.percentiles(df.limit(0), keys, "x", shares).count() == 0


def pairs_of(rows, keys):
    by = {}
    for g, h, x, y in rows:
        if x is not None and y is not None:
            by.setdefault(tuple({"g": g, "h": h}[k] for k in keys), []).append((x, y))
    out = {}
    for k, v in by.items():
        apart = [(a, b) for a, b in itertools.combinations(v, 2) if a[1] != b[1]]
        out[k] = len(apart), sum((a[0] - b[0]) * (a[1] - b[1]) > 0 for a, b in apart)
    return out


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
@pytest.mark.parametrize("most", [1 << 20, 60, 1])
def test_pairs_equal_all_pairs(many_ranges, keys, most):
    rows, df = table(many_ranges, 400, 2)
    got = {tuple(r[k] for k in keys): (r["pairs"], r["correct"]) for r in ordered.ordered_pairs(df, keys, "x", "y", most).collect()}
    assert got == pairs_of(rows, keys)


def test_pairs_of_one_tie_and_of_nothing(many_ranges):
    flat = many_ranges.createDataFrame([(1.0, float(i)) for i in range(300)], "x double, y double")
    assert ordered.ordered_pairs(flat, [], "x", "y", 10).collect() == [(300 * 299 // 2, 0)]
    assert ordered.ordered_pairs(flat.select(F.col("y").alias("x"), F.col("x").alias("y")), [], "x", "y", 10).collect() == [(0, 0)]
    assert ordered.ordered_pairs(flat.select("y", (-F.col("y")).alias("x")), [], "x", "y", 10).collect() == [(300 * 299 // 2, 0)]
    assert ordered.ordered_pairs(flat.limit(0), [], "x", "y", 10).collect() == []


def test_rows_that_stand_for_many(spark):
    rows = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 1.0, 2), ("b", 2.0, 1)], "k string, x double, n long")
    got = {r["k"]: (r["_count"], r["m"], r["t"]) for r in ordered.percentiles(rows, ["k"], "x", {"m": 0.5, "t": 0.9}, "n").collect()}
    assert got == {"a": (6, 1.0, 3.0), "b": (1, 2.0, 2.0)}


def test_summaries_come_from_one_pass_over_the_records(spark):
    """The fine values give the coarse summary too, and what works the records out is written once before anything is filtered."""
    rows = spark.createDataFrame([(i, "ab"[i % 2], 4 * (i % 3)) for i in range(30)], "sample_id long, task_family string, text_tokens long")
    rows = rows.selectExpr("*", "array(named_struct('grid_thw', array(1L, 2L, 2L), 'width', 28L, 'height', 28L, 'frames', 1L, 'visual_tokens', 1L, 'pixels', 784L)) AS images", "0L AS padded_tokens", "0L AS label_tokens", "0L AS repeated_prompt_tokens")
    records = media.media_records(rows)
    values = media.media_values(records, ["task_family"])
    assert "grid_thw" not in values._jdf.queryExecution().optimizedPlan().toString()
    coarse = {tuple(r) for r in media.summary_of(values).collect()}
    assert coarse == {tuple(r) for r in media.media_summary(records).collect()}
    assert {r[1] for r in coarse} == {30}
