"""Hand-computed cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gantry.functions import nested, numeric, strings
from gantry.operators import aggregates as A
from gantry.operators import generators as G
from gantry.operators import models as M
from gantry.operators import relational as R
from gantry.operators import windows as W
from gantry.operators.ordered import dominance
from gantry.sources import readers, schemas, sinks
from gantry.streaming import incremental as inc


def test_rank_reduction_and_window(spark):
    rows = spark.createDataFrame(
        [("J", 1, 0, 2.0, 100, 80, 8, 10), ("J", 1, 1, 2.5, 100, 80, 8, 12), ("J", 2, 0, 1.5, 100, 80, 8, 11), ("J", 2, 1, 1.0, 100, 80, 8, 9)],
        "job string, step int, rank int, seconds double, computed long, effective long, samples long, memory long",
    ).withColumn("warm", F.lit(False))
    steps = A.rank_reduce(rows, ["job", "step"], ["computed", "effective", "samples"], ["seconds", "memory"], "warm")
    assert {r["step"]: (r["seconds"], r["computed"], r["samples"], r["memory"]) for r in steps.collect()} == {1: (2.5, 200, 16, 12), 2: (1.5, 200, 16, 11)}
    r = A.rolling_window(steps, "job", "step", "seconds", ["computed", "effective", "samples"], "warm").first()
    assert (r["window_seconds"], r["computed_rate"], r["effective_rate"], r["samples_rate"], r["p50"]) == (4.0, 100, 80, 8, 2.0)
    assert r["p90"] == pytest.approx(2.4)


def test_energy(spark):
    rows = spark.createDataFrame([(0, 0.0, 100.0), (0, 4.0, 200.0), (0, 30.0, 200.0)], "gpu int, t double, p double")
    assert A.energy(rows, ["gpu"], F.col("t"), "p").first()["energy_wh"] == pytest.approx(2600 / 3600)
    gap = rows.withColumn("p", F.when(F.col("t") != 4.0, F.col("p")))
    assert A.energy(gap, ["gpu"], F.col("t"), "p").first()["energy_wh"] == 0


def test_scaling_and_packing(spark):
    points = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 19.0), ("s", 4, 30.0)], "s string, cards int, v double")
    out = {r["cards"]: r["decision"] for r in W.early_stop(points, ["s"], "cards", "v", 1.8).collect()}
    assert out == {1: "pass", 2: "pass", 4: "fail"}
    pairs = spark.createDataFrame([("q", 1, 0, 10.0), ("q", 1, 1, 12.5)], "request string, repeat int, packing int, rate double")
    got = R.paired(pairs, ["request", "repeat"], "packing", 0, 1, "rate")
    assert got.first()["gain"] == pytest.approx(0.2)


def test_greedy_packs_and_bins():
    assert G.greedy_packs([7, 5, 4, 3, 1], 10) == [[7, 3], [5, 4, 1]]
    assert sorted(G.best_fit_bins([7, 5, 4, 3, 1], 10)) == [0, 0]
    with pytest.raises(ValueError):
        G.greedy_packs([11], 10)


def test_waves():
    assert G.mixed_waves([("a", 4), ("b", 2)], 6) == [["a", "b"]]
    with pytest.raises(ValueError):
        G.mixed_waves([("a", 4), ("b", 2)], 5)
    assert G.unbounded_fill(6, [4, 2]) == [4, 2]
    assert G.first_fit_masks([("a", 2), ("b", 1), ("c", 2)], [0, 1, 2]) == [[("a", [0, 1]), ("b", [2])], [("c", [0, 1])]]
    assert G.first_fit_masks([("a", 1), ("b", 4), ("c", 2)], [0, 1, 2, 3]) == [[("b", [0, 1, 2, 3])], [("c", [0, 1]), ("a", [2])]]
    assert G.first_fit_masks([("a", 1), ("b", 2, True), ("c", 1)], [0, 1, 2, 3]) == [[("a", [0]), ("c", [1])], [("b", [0, 1])]]
    assert G.first_fit_masks([("a", 1), ("b", 2)], [0, 1, 2, 3], in_order=True) == [[("a", [0]), ("b", [2, 3])]]


def test_expected_batch_max(spark):
    rows = spark.createDataFrame([("d", 1, 1), ("d", 2, 2)], "g string, id int, n int")
    assert W.expected_batch_max(rows, ["g"], "n", "id", [2]).first()["expected"] == pytest.approx(1.75)


def test_operations(spark):
    p = numeric.forward_parts(F.lit(1), F.lit(1), hidden=64, inner=128, layers=2, query=64, kv=32, vocab=1024)
    r = spark.range(1).select(*(c.alias(k) for k, c in p.items()), numeric.training_operations(F.lit("full"), p).alias("full")).first()
    assert (r["linear"], r["attention"], r["head"], r["full"]) == (147456, 256, 131072, 836352)


def test_conformal_ranks(spark):
    rows = spark.range(37).select(F.when(F.col("id") < 18, "a").otherwise("b").alias("g"), F.col("id").cast("double").alias("v"))
    out = {r["g"]: r for r in M.conformal(rows, ["g"], "v", "0.95").collect()}
    assert (out["a"]["rank"], out["a"]["bound"]) == (19, None)
    assert (out["b"]["rank"], out["b"]["bound"]) == (19, 36.0)


def test_isotonic_and_fits():
    assert M.isotonic([1, 3, 2, 4], [1, 1, 1, 1]) == [1, 2.5, 2.5, 4]
    x = np.linspace(0, 2, 30)
    assert M.curve_fit(lambda x, b: b[0] * np.exp(b[1] * x), [1.0, 0.0], x, 2 * np.exp(0.7 * x)) == pytest.approx([2, 0.7], rel=1e-5)
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 1))
    y = 1 + 2 * z[:, 0] + 0.1 * rng.normal(size=400)
    cut = y > 2
    assert M.tobit(z, np.minimum(y, 2), cut)[:2] == pytest.approx([1, 2], abs=0.05)
    fit = M.StructuredFit().fit(z, y, np.arange(400) % 20)
    assert fit.coefficients == pytest.approx([1, 2], abs=0.05)


def test_conversations(spark):
    def ok(*m):
        df = spark.createDataFrame([([{"role": r, "content": c} for r, c in m],)], "messages array<struct<role:string,content:string>>")
        return df.select(nested.valid_conversation(F.col("messages")).alias("v")).first()["v"]

    assert ok(("user", "a"), ("assistant", "b"))
    assert ok(("system", "s"), ("user", "a"), ("assistant", "b"))
    assert not ok(("assistant", "b"), ("user", "a"))
    assert not ok(("user", "a"))
    assert not ok(("user", " "), ("assistant", "b"))


def test_memory_amount_and_index_list(spark):
    r = spark.range(1).select(
        strings.memory_amount(F.lit("Tried to allocate 1.50 GiB. GPU has"), "tried to allocate").alias("a"), strings.memory_amount(F.lit("none"), "tried to allocate").alias("b"), strings.index_list(F.lit("0,2,4-7")).alias("c")
    ).first()
    assert (r["a"], r["b"], r["c"]) == (1610612736, None, [0, 2, 4, 5, 6, 7])


def test_sources_and_sinks(spark, tmp_path):
    run = tmp_path / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "status.json").write_text(json.dumps({"classification": "success", "started_unix": 1.0}))
    (run / "rendered_run.json").write_text(json.dumps({"job": {"job_id": "J"}, "command": ["x"]}))
    (tmp_path / "runs" / "r2").mkdir()
    (tmp_path / "runs" / "r2" / "status.json").write_text("{}")
    assert [r["job"]["job_id"] for r in readers.runs(spark, str(tmp_path / "runs")).collect()] == ["J"]
    events = tmp_path / "events.rank3.jsonl"
    events.write_text('{"event":"step_end","time_unix":2.0}\n\nbroken\n')
    got = readers.rank_events(spark, str(events)).collect()
    assert [(r["event"], r["rank"]) for r in got] == [("step_end", 3)]
    assert readers.malformed_counts(readers.lenient_lines(spark, str(events), schemas.EVENT)).first()["malformed_lines"] == 1
    csv = tmp_path / "gpu.csv"
    csv.write_text("timestamp, index, memory, utilization, power, clock\n2026/01/01 00:00:01.500, 0, 10, 90, [N/A], 1500\n")
    r = readers.telemetry(spark, str(csv)).first()
    assert (r["gpu_index"], r["power"], r["clock"], r["thermal_limit"]) == (0, None, 1500.0, None)
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\nthree\n")
    assert readers.log_tail(spark, str(log), str(tmp_path), 8).first()["tail"] == "three\n"
    for outside in (f"{tmp_path}/../a.log", f"{tmp_path}x/a.log", "/etc/hosts"):
        with pytest.raises(ValueError):
            readers.log_tail(spark, outside, str(tmp_path))
    sinks.write_report({"b": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"b": 1}
    nested_rows = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    sinks.write_parquet(nested_rows, str(tmp_path / "p"), nested_as_text=True)
    assert spark.read.parquet(str(tmp_path / "p")).first()["b"] == "[1,2]"
    assert sinks.markdown(nested_rows.select("a")).splitlines() == ["| a |", "|-|", "| 1 |"]


def test_stream_equals_batch(spark, tmp_path):
    """Files replayed out of order and twice give what one batch gives."""
    land, state = tmp_path / "land", tmp_path / "state"
    land.mkdir()
    rows = [("J", 1, 1.0, 10), ("J", 2, 2.0, 10), ("K", 1, 1.5, 7), ("J", 2, 3.0, 11)]
    for k, part in enumerate((rows[2:], rows[:2], rows[2:])):
        (land / f"{k}.jsonl").write_text("".join(json.dumps({"job_id": j, "global_step": s, "time_unix": t, "step_seconds": float(n)}) + "\n" for j, s, t, n in part))
    stream = inc.tail(spark, str(land), schemas.EVENT, per_trigger=1).select("job_id", "global_step", "time_unix", "step_seconds")
    fold = lambda h: h.groupBy("job_id").agg(F.sum("step_seconds").alias("s"), F.count("*").alias("n"))
    write = inc.upsert_batches(str(state / "steps"), ["job_id", "global_step"], ["time_unix"], fold, str(state / "jobs"))
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(state / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r["job_id"]: (r["s"], r["n"]) for r in inc.current(spark, str(state / "jobs"), "job_id").collect()}
    assert got == {"J": (21.0, 2), "K": (7.0, 1)}


def test_states_and_fences(spark):
    rows = spark.createDataFrame([("j", 1.0, "train_begin", 0), ("j", 2.0, "step_end", 5), ("j", 3.0, "train_begin", 0), ("j", 4.0, "step_end", 7)], "job_id string, time_unix double, event string, tokens long")
    assert inc.fenced(rows, "job_id", "time_unix", F.col("event") == "train_begin").count() == 2
    states = spark.createDataFrame([("a", 1, 1, "running"), ("a", 2, 2, "success"), ("a", 3, 3, "failed"), ("b", 1, 1, None)], "job string, t int, o int, s string")
    assert {r["job"]: r["state"] for r in inc.latest_states(states, "job", "s", "t", "o").collect()} == {"a": "success", "b": "planned"}


def test_telemetry_takes_whole_numbers_only(spark):
    texts = ["12abc", "1e5", " 3.5 ", "N/A", "[Not Supported]", "", "12 W", "-.5", "nan", "12d", None]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strings.maybe_number(F.col("t")).alias("v")).collect()]
    assert [None if v is None or v != v else v for v in got] == [None, 100000.0, 3.5, None, None, None, None, -0.5, None, None, None] and got[8] != got[8]


def test_ids_are_those_of_canonical_json(spark):
    import hashlib

    payload = {"b": 1, "a": "é", "c": None, "d": True}
    want = hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    parts = {"b": F.lit(1), "a": F.lit("é"), "c": F.lit(None).cast("string"), "d": F.lit(True)}
    r = spark.range(1).select(strings.stable_id("run", **parts).alias("x"), strings.stable_id("run", 8, **dict(reversed(parts.items()))).alias("y")).first()
    assert (r["x"], r["y"]) == (f"run-{want[:16]}", f"run-{want[:8]}")


def test_phases_and_categories(spark):
    jobs = [("preflight-1", "throughput", "preflight"), ("h800val-2", "", "validation"), ("x", "smoke", "validation"), ("mem-1", None, "memory"), ("packoff-1", "", "packing"), ("prof-1", "", "profiler"), ("scale-1", "throughput", "scaling"), ("tputd-1", "", "throughput"), (None, None, "other")]
    got = spark.createDataFrame([(i, k) for i, k, _ in jobs], "i string, k string").select(strings.job_phase(F.col("i"), F.col("k")).alias("p")).collect()
    assert [r["p"] for r in got] == [p for _, _, p in jobs]
    rows = spark.createDataFrame([(100.0, 512.0, 900.0), (1000.0, 1500.0, 1750.0), (9000.0, 9500.0, 9900.0), (1000.0, 1200.0, 1500.0), (0.5, 513.0, 600.0)], "a double, b double, c double")
    assert [r["x"] for r in rows.select(strings.length_category(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == ["short", "longtail", "longcontext", "multiturn", "longtail"]


def test_vision_tower_by_hand(spark):
    small = dict(depth=1, hidden=2, inner=3, out=5, patch=2, merge=2, temporal=2, channels=3)
    plain, gated = numeric.vision_tower(**small, positions=7, taps=2), numeric.vision_tower(**small, gated=True)
    r = spark.range(1).select(*(c.alias(f"p_{k}") for k, c in plain.items()), *(c.alias(f"g_{k}") for k, c in gated.items())).first()
    # patches 3*2*2*2*2; block 4*4+4*2, feed-forward 2*2*3+3+2, norms 8; merger 16 + 64+8 + 40+5
    assert (r["p_patch_embed"], r["p_blocks"], r["p_merger"], r["p_positions"], r["p_tap_mergers"], r["p_total"]) == (48, 49, 133, 14, 266, 510)
    assert (r["g_blocks"], r["g_merger"], r["g_total"]) == (24 + (2 * (6 + 3) + 6 + 2) + 4, 2 + 72 + 45, 48 + 54 + 119)


def test_memory_components_by_hand(spark):
    g = {"loaded": 1000, "trainable": 100, "hidden": 4, "inner": 8, "kv": 2, "layers": 3, "heads": 2, "vocab": 10, "module": 50, "persistent": 7}
    out = {}
    for stage in range(4):
        c = numeric.memory_components(g, cards=F.lit(2), micro=F.lit(1), cutoff=F.lit(5), stage=F.lit(stage), checkpointing=F.lit(stage == 3))
        out[stage] = spark.range(1).select(*(v.alias(k) for k, v in c.items())).first().asDict()
    assert [out[s]["parameters"] for s in range(4)] == [2000, 2000, 2000, 1000] and [out[s]["optimizer"] for s in range(4)] == [1200, 600, 600, 600]
    assert out[0]["saved"] == 5 * 3 * (24 + 4 + 24) * 2 and out[3]["saved"] == 5 * 3 * 4 * 2 and out[3]["recompute"] == 5 * 52 * 2
    assert out[1]["attention"] == 5 * 12 * 2 + 5 * 2 * 4 and out[1]["collective"] == 200 and out[3]["live"] == 1000 * 2 * 0.5 and out[0]["collective"] == 0


def test_classes_weigh_the_same(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1), ("b", 0), ("c", 0)], "s string, y int")
    got = M.balanced(rows, "s", F.col("y") == 1).collect()
    assert sum(r["weight"] for r in got if r["y"] == 1) == pytest.approx(0.5) == sum(r["weight"] for r in got if r["y"] == 0)
    one = {(r["s"], r["y"]): r["weight"] for r in got}
    assert one["a", 1] / one["b", 1] == pytest.approx(3 / 2)


def test_censored_ridge_against_a_plain_fit(spark):
    r = np.random.default_rng(2)
    x, cens = r.normal(size=60), r.random(60) < 0.3
    y = 1 + 2 * x + r.normal(size=60) * 0.3
    y[5] += 9
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for a, b, c in zip(x, y, cens, strict=True)], "x double, y double, c boolean")
    got = M.censored_ridge(df, {"x": F.col("x")}, F.col("y"), F.col("c"), alpha=0.5, delta=0.4)
    design, penalty = np.column_stack([np.ones(60), x]), np.diag([0, 0.5])
    solve = lambda w: np.linalg.solve(design.T @ (w[:, None] * design) + penalty, design.T @ (w * y))
    b, active = solve((~cens).astype(float)), None
    for _ in range(100):
        p = design @ b
        on = cens & (p < y)
        w = np.where(~cens | on, np.minimum(1, 0.4 / np.maximum(np.abs(p - y), 1e-12)), 0)
        new = solve(w)
        done = active is not None and (active == on).all() and np.abs(new - b).max() < 1e-9
        b, active = new, on
        if done:
            break
    assert got == pytest.approx(b, abs=1e-7)


def test_pairs_are_counted_not_formed(spark):
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        p, o, w = r.integers(0, 9, n).astype(float), r.integers(0, 9, n).astype(float), r.integers(1, 4, n)
        rows = [(a, b) for a, b, k in zip(p, o, w, strict=True) for _ in range(k)]
        pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if x[1] != y[1]]
        assert dominance(p, o, w) == sum((x[0] - y[0]) * (x[1] - y[1]) > 0 for x, y in pairs)
    rows = [(int(g), i, float(a), float(b), float(c)) for i, (g, a, b, c) in enumerate(zip(r.integers(0, 3, 30), r.normal(size=30), r.normal(size=30), r.normal(size=30), strict=True))]
    g = M.pair_gram(spark.createDataFrame(rows, "s int, i int, a double, b double, y double"), "s", "i", ["a", "b"], "y")
    deltas = np.array([np.subtract(v[2:], u[2:]) for u in rows for v in rows if u[0] == v[0] and u[1] < v[1]])
    z = np.column_stack([np.ones(len(deltas)), deltas[:, :2]])
    assert np.allclose(g.xx, z.T @ z) and np.allclose(g.xy, z.T @ deltas[:, 2]) and g.weight == len(deltas)


def test_nested_cv_against_plain_loops(spark):
    r = np.random.default_rng(5)
    src = np.repeat([f"s{k}" for k in range(8)], r.integers(6, 14, 8))
    x1, x2 = r.normal(size=len(src)), r.normal(size=len(src))
    y = 0.5 + 0.8 * x1 + 0.1 * r.normal(size=len(src))
    df = spark.createDataFrame([(s, float(a), float(b), float(c)) for s, a, b, c in zip(src, x1, x2, y, strict=True)], "s string, a double, b double, y double")
    options = {"a": (["a"], 1e-6), "b": (["b"], 1e-6), "ab": (["a", "b"], 5.0)}
    got = {row["outer_fold"]: row for row in M.nested_cv(df, "s", {"a": F.col("a"), "b": F.col("b")}, F.col("y"), options, outer=3, inner=2).collect()}
    columns = {"a": x1, "b": x2}

    def folds(names, k):
        load, out = [0] * k, {}
        for s in sorted(names, key=lambda s: (-(src == s).sum(), s)):
            at = min(range(k), key=lambda i: (load[i], i))
            out[s] = at
            load[at] += (src == s).sum()
        return out

    def errors(train, test, name):
        chosen, alpha = options[name]
        z = np.column_stack([np.ones(len(src)), *(columns[c] for c in chosen)])
        b = np.linalg.solve(z[train].T @ z[train] + np.diag([0.0] + [alpha] * len(chosen)), z[train].T @ y[train])
        return np.abs(np.exp(z[test] @ b - y[test]) - 1)

    outer = folds(set(src), 3)
    for o in range(3):
        held = np.array([outer[s] == o for s in src])
        inner = folds({s for s in src if outer[s] != o}, 2)
        scores = {}
        for name in options:
            e, who = [], []
            for i in range(2):
                test = np.array([inner.get(s) == i for s in src])
                e.append(errors(~held & ~test, test, name))
                who.append(src[test])
            e, who = np.concatenate(e), np.concatenate(who)
            scores[name] = np.mean([e[who == s].mean() for s in set(who)])
        best = min(scores, key=scores.get)
        e = errors(~held, held, best)
        assert got[o]["candidate"] == best and got[o]["inner_error"] == pytest.approx(scores[best]) and got[o]["outer_error"] == pytest.approx(np.mean([e[src[held] == s].mean() for s in set(src[held])]))


def test_calibration_by_role(spark):
    rows = [("c1", "calibration", 0.0, 0.0, 100.0), ("c2", "calibration", 1.0, 0.0, 210.0), ("h1", "holdout", 0.0, 1.0, 120.0), ("h2", "holdout", 1.0, 1.0, 250.0), ("x", "other", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, role string, a double, g double, seen double")
    beta, out = M.role_calibration(df, "id", "role", {"a": F.col("a"), "g": F.col("g")}, F.col("seen") / 100, F.lit(100.0), F.col("seen"))
    used = {r["id"]: r["used_as"] for r in out.collect()}
    assert used == {"c1": "calibration", "c2": "calibration", "h2": "fallback_calibration", "h1": "holdout"}  # both raise the rank; the last id wins
    assert beta == pytest.approx([0, np.log(2.1), np.log(250 / 210)], abs=1e-4)
    with pytest.raises(ValueError):
        M.role_calibration(df.limit(1), "id", "role", {"a": F.col("a")}, F.col("seen") / 100, F.lit(100.0), F.col("seen"))


def test_batches_must_not_collide(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    with pytest.raises(ValueError, match="collides"):
        R.disjoint_union({"a": a, "b": b}, "k")
    assert R.disjoint_union({"a": a, "b": b.where("k = 3")}, "k").count() == 3


def test_capped_conversations(spark):
    m = [{"role": "system", "content": "s " * 50}, {"role": "user", "content": "u " * 100}, {"role": "assistant", "content": "a " * 100}]
    df = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    for cap, want in ((250, (50, 100, 100)), (200, (50, 50, 100)), (170, (38, 32, 100)), (100, (32, 32, 36)), (95, None)):
        r = df.select(nested.capped(F.col("m"), cap).alias("m")).first()["m"]
        assert (None if r is None else tuple(len(x["content"].split()) for x in r)) == want, cap


def test_loops_keep_errors_and_beat():
    found = iter([3, ValueError("broken"), 5])

    def scan():
        x = next(found)
        if isinstance(x, Exception):
            raise x
        return x

    waits: list = []
    assert inc.poll(scan, 3, 2.0, waits.append) == [(3, None), (0, "ValueError: broken"), (5, None)] and waits == [2.0, 2.0]
    now, revisions = [0.0], iter([1, 1, 1, 2, 2, 2, 2])

    def sleep(s):
        now[0] += s

    said = list(inc.changes(lambda: next(revisions), 7, 8.0, 15.0, lambda: now[0], sleep))
    assert said == [("revision", 1), ("heartbeat", 1), ("revision", 2), ("heartbeat", 2)]


def test_named_files_and_linked_views(spark, tmp_path):
    from gantry.sources import files

    rows = spark.createDataFrame([("a/x.txt", 2, "two"), ("a/x.txt", 1, "one"), ("b=1.txt", 1, "é")], "name string, n int, value string")
    files.write_named(rows.repartition(3), str(tmp_path / "out"), "n")
    assert (tmp_path / "out" / "a" / "x.txt").read_text() == "one\ntwo\n" and (tmp_path / "out" / "b=1.txt").read_text() == "é\n"
    assert files.read_range(spark, str(tmp_path / "out" / "a" / "x.txt"), 2, 4) == b"e\ntw" and files.length(spark, str(tmp_path / "none")) is None
