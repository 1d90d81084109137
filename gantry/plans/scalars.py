"""Queries over scalar, text and nested functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.functions import nested as A
from gantry.functions import numeric as N
from gantry.functions import stats as S
from gantry.functions import strings as T
from gantry.functions import tokens
from gantry.operators import media as M
from gantry.plans.base import query
from gantry.session import materialise

@query("""SELECT p_partkey, greatest(512, CAST(ceil(p_retailprice / 512) AS BIGINT) * 512) AS cutoff, round(p_size / nullif(p_partkey % 5, 0), 9) AS ratio FROM part""")
def aligned_cutoffs(t):
    return t.part.select("p_partkey", N.aligned_cutoff(F.col("p_retailprice")).alias("cutoff"), F.round(S.rate("p_size", F.col("p_partkey") % 5), 9).alias("ratio"))


@query("""WITH x AS (SELECT p_partkey, 100 + p_partkey % 57 AS b, (1 + p_partkey % 3) * (1 + p_size % 7) AS per FROM part), y AS (SELECT *, greatest(1, CAST(floor(b / per) AS BIGINT)) AS lo, greatest(1, CAST(ceil(b / per) AS BIGINT)) AS hi FROM x)
SELECT p_partkey, CASE WHEN abs(per * lo - b) <= abs(per * hi - b) THEN lo ELSE hi END AS steps, CASE WHEN per <= b AND b % per = 0 THEN b // per END AS exact FROM y""")
def ga_derivation(t):
    b, g, m = F.lit(100) + F.col("p_partkey") % 57, F.col("p_partkey") % 3 + 1, F.col("p_size") % 7 + 1
    return t.part.select("p_partkey", N.accumulation(b, g, m).alias("steps"), N.exact_accumulation(b, g, m).alias("exact"))


_FLOPS = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS tok, l_quantity * l_quantity AS pairs, 64.0 AS h, 128.0 AS i, 2.0 AS l, 64.0 AS q, 32.0 AS kv, 1024.0 AS v, l_returnflag FROM lineitem),
f AS (SELECT *, l * (2 * h * (q + 2 * kv) + 2 * q * h + 6 * h * i) * tok AS lin, l * 2 * q * pairs AS att, 2 * h * v * tok AS head, l * 2 * 32 * (9 * h + 2 * kv + 3 * i) * tok AS lora FROM x)"""


@query(f"""WITH {_FLOPS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 2 * lin + 3 * att + 2 * head + 3 * lora ELSE 3 * (lin + att + head) END AS operations FROM f""")
def flops(t):
    parts = N.forward_parts(F.col("l_quantity"), F.col("l_quantity") * F.col("l_quantity"), hidden=64, inner=128, layers=2, query=64, kv=32, vocab=1024)
    mode = F.when(F.col("l_returnflag") == "R", "lora").otherwise("full")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.training_operations(mode, parts).alias("operations"))


@query(f"""WITH {_FLOPS}, s AS (SELECT l_orderkey, sum(3 * (lin + att + head)) AS o, sum(tok * tok) AS p, sum(tok) AS n FROM f GROUP BY l_orderkey) SELECT l_orderkey, p AS pairs, round(o / (n * 4 * 1e6), 9) AS mfu, round(o / (n * 4 * 1e6) / 0.9, 9) AS adjusted FROM s""")
def sequence_mfu(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("lengths"))
    tokens, pairs = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x), N.sequence_pairs(F.col("lengths"))
    parts = N.forward_parts(tokens, pairs, hidden=64, inner=128, layers=2, query=64, kv=32, vocab=1024)
    mfu = N.utilisation(N.training_operations(F.lit("full"), parts), tokens, F.lit(4), 1e6)
    return per.select("l_orderkey", pairs.alias("pairs"), F.round(mfu, 9).alias("mfu"), F.round(N.clock_adjusted(mfu, F.lit(0.9)), 9).alias("adjusted"))


@query("""WITH x AS (SELECT p_partkey, p_partkey * 1000003 + 7 AS params, p_partkey * 10007 + 3 AS train, CAST(pow(2, p_size % 3) AS BIGINT) AS cards, p_partkey % 4 AS stage FROM part)
SELECT p_partkey, CASE WHEN stage >= 3 THEN (params * 2) // cards + (train * 12) // cards WHEN stage >= 1 THEN params * 2 + (train * 12) // cards ELSE params * 2 + train * 12 END AS floor_bytes FROM x""")
def state_floor(t):
    cards = F.pow(F.lit(2), F.col("p_size") % 3).cast("long")
    return t.part.select("p_partkey", N.state_floor(F.col("p_partkey") * 1000003 + 7, F.col("p_partkey") * 10007 + 3, cards, F.col("p_partkey") % 4).alias("floor_bytes"))


_GEOMETRY = """x AS (SELECT p_partkey, p_partkey * 3000000.0::DOUBLE AS loaded, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 3000000.0::DOUBLE ELSE p_partkey * 30000.0::DOUBLE END AS trainable, p_partkey % 2 = 0 AS "full",
1024.0::DOUBLE AS hidden, 2816.0::DOUBLE AS "inner", 256.0::DOUBLE AS kv, 24.0::DOUBLE AS layers, 16.0::DOUBLE AS heads, 32000.0::DOUBLE AS vocab, p_partkey * 2500000.0::DOUBLE AS linear, p_partkey * 30000.0::DOUBLE AS adapter,
CAST(pow(2, p_size % 3) AS DOUBLE) AS g, p_partkey % 4 AS z, (1 + p_size % 8) AS m, p_size % 2 = 0 AS gc FROM part)"""


def _geometry(t):
    key, full = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    geometry = {
        "loaded": key * 3000000.0, "trainable": F.when(full, key * 3000000.0).otherwise(key * 30000.0), "hidden": F.lit(1024.0), "inner": F.lit(2816.0), "kv": F.lit(256.0), "layers": F.lit(24.0),
        "heads": F.lit(16.0), "vocab": F.lit(32000.0), "linear": key * 2500000.0, "adapter": key * 30000.0, "module": F.lit(32000.0 * 1024), "persistent": F.lit(50000.0),
    }
    job = {"cards": F.pow(F.lit(2.0), F.col("p_size") % 3), "stage": key % 4, "checkpointing": F.col("p_size") % 2 == 0}
    return geometry, job, F.when(full, "full").otherwise("lora")


@query(f"""WITH {_GEOMETRY}, c AS (SELECT *, m * 2048.0::DOUBLE AS tok, 6 * hidden + 2 * kv + 3 * "inner" AS width, least(trainable, 5e8) * 2 AS red, least(loaded, least(loaded, 2e9) + 32768000 + 50000) AS live_n FROM x),
k AS (SELECT p_partkey, CASE WHEN z = 3 THEN loaded * 2 / g ELSE loaded * 2 END AS parameters, CASE WHEN z >= 2 THEN trainable * 2 / g ELSE trainable * 2 END AS gradients, CASE WHEN z >= 1 THEN trainable * 12 / g ELSE trainable * 12 END AS optimizer,
CASE WHEN gc THEN tok * layers * hidden * 2 ELSE tok * layers * width * 2 END AS saved, CASE WHEN gc THEN tok * width * 2 ELSE 0 END AS recompute, tok * (2 * hidden + 2 * kv) * 2 + tok * heads * 4 AS attention, tok * vocab * 4 AS logits,
CASE z WHEN 0 THEN 0 WHEN 2 THEN greatest(red, least(trainable, 5e8) * 2) ELSE red END AS collective, CASE WHEN z = 3 AND g > 1 THEN live_n * 2 * (1 - 1 / g) ELSE 0 END AS live FROM c),
r AS (SELECT *, parameters + gradients + optimizer + logits + collective + live AS rest, saved + recompute + attention AS act FROM k)
SELECT p_partkey, round(parameters, 1) AS parameters, round(gradients, 1) AS gradients, round(optimizer, 1) AS optimizer, saved, recompute, attention, logits, collective, round(live, 1) AS live, round(rest + act, 1) AS reference, round(rest, 1) AS non_activation, round(rest + act * 0.25, 1) AS lower_bound FROM r""")
def memory_basis(t):
    geometry, job, _ = _geometry(t)
    c = N.memory_components(geometry, micro=F.col("p_size") % 8 + 1, cutoff=F.lit(2048), **job)
    out = t.part.select("p_partkey", *(v.alias(k) for k, v in c.items()))
    sums = N.memory_reference({k: F.col(k) for k in c})
    return out.select("p_partkey", *((F.round(k, 1) if k in ("parameters", "gradients", "optimizer", "live") else F.col(k)).alias(k) for k in c), *(F.round(v, 1).alias(k) for k, v in sums.items()))


@query("""SELECT p_partkey, p_size * 100 + greatest(p_partkey * 3, p_size * 70) AS peak FROM part""")
def phase_peak(t):
    return t.part.select("p_partkey", N.phase_peak(F.col("p_size") * 60, F.col("p_size") * 40, F.col("p_partkey") * 3, F.col("p_size") * 70).alias("peak"))


@query(f"""WITH {_GEOMETRY}, c AS (SELECT *, p_partkey * 4096.0::DOUBLE AS tok, p_partkey * 65536.0::DOUBLE AS pairs, (1 + p_partkey % 5)::DOUBLE AS ga, 6 * hidden + 2 * kv + 3 * "inner" AS width, layers * hidden * p_partkey * 65536.0::DOUBLE AS sq FROM x),
o AS (SELECT *, CASE WHEN "full" THEN 6 * linear * tok ELSE 4 * linear * tok + 6 * adapter * tok END AS lin, 6 * sq AS att, CASE WHEN NOT gc THEN 0 WHEN "full" THEN 2 * linear * tok ELSE 2 * linear * tok + 2 * adapter * tok END AS rl, CASE WHEN gc THEN 2 * sq ELSE 0 END AS ra,
ga * 2 * (linear + adapter) * 2 AS w, 4 * (tok / g) * layers * width * 2 AS act, 4 * (tok / g) * (2 * hidden + 2 * kv) * 2 AS att_t, 2 * trainable / g * 16 AS opt, CASE WHEN gc THEN 3 ELSE 2 END AS mat FROM c),
p AS (SELECT *, w + act + att_t + CASE WHEN gc THEN 2 * (act + att_t) ELSE 0 END AS kern, CASE WHEN g = 1 OR z = 0 THEN 0 WHEN z = 1 THEN (g - 1) / g * (2 * trainable * 2 + trainable * 2) WHEN z = 2 THEN (g - 1) / g * (2 * ga * trainable * 2 + trainable * 2) ELSE (g - 1) / g * ga * (mat * loaded * 2 + trainable * 2) END AS pay,
CASE WHEN g = 1 OR z = 0 THEN 0 WHEN z = 1 THEN 2 * ceil(trainable / 5e8) WHEN z = 2 THEN ga * ceil(trainable / 5e8) + ceil(trainable / 5e8) ELSE ga * (mat * ceil(loaded / 5e7) + ceil(trainable / 5e8)) END AS n FROM o)
SELECT p_partkey, round(lin / 1e9, 3) AS linear, round(att / 1e9, 3) AS attention, round(rl / 1e9, 3) AS recompute_linear, round(ra / 1e9, 3) AS recompute_attention, round(kern / 1e6, 3) AS kernel, round(opt / 1e6, 3) AS optimizer, round(pay / 1e6, 3) AS payload, CAST(n AS BIGINT) AS collectives,
round((lin + att + rl + ra) / (g * 1e14), 6) AS compute_seconds, round(pay / 4e11, 12) AS payload_seconds FROM p""")
def performance_basis(t):
    geometry, job, mode = _geometry(t)
    key = F.col("p_partkey")
    c = N.performance_basis(geometry, mode=mode, tokens=key * 4096.0, pairs=key * 65536.0, accumulation=key % 5 + 1, peak=1e14, memory_bandwidth=3e12, link_bandwidth=4e11, **job)
    scaled = {k: F.round(c[k] / 1e9, 3) for k in ("linear", "attention", "recompute_linear", "recompute_attention")} | {k: F.round(c[k] / 1e6, 3) for k in ("kernel", "optimizer", "payload")}
    return t.part.select("p_partkey", *(v.alias(k) for k, v in scaled.items()), c["collectives"].alias("collectives"), F.round(c["compute_seconds"], 6).alias("compute_seconds"), F.round(c["payload_seconds"], 12).alias("payload_seconds"))


@query("""WITH b AS (SELECT *, p_retailprice / 1e3 AS c, p_size / 10.0 AS h FROM part)
SELECT p_partkey, round(pow(pow(c, 4.0) + pow(h, 4.0), 0.25) * exp(tanh((p_partkey % 7 - 3) / 0.5) * 0.5), 6) AS seconds, round(greatest(c - 3, 0.0) + ln(1 + exp(-abs(c - 3))), 8) AS softplus FROM b""")
def roofline(t):
    c, h = F.col("p_retailprice") / 1e3, F.col("p_size") / 10.0
    return t.part.select("p_partkey", F.round(N.roofline(c, h, 4.0, (F.col("p_partkey") % 7 - 3).cast("double"), 0.5), 6).alias("seconds"), F.round(N.softplus(c - 3), 8).alias("softplus"))


@query("""WITH x AS (SELECT p_partkey, 128 AS b, CAST(pow(2, p_size % 3) AS BIGINT) AS dp, 1 + p_size / 10.0 AS spp, 40.0 + p_size * 3 AS p99 FROM part), y AS (SELECT *, greatest(1, CAST(round(b / (dp * spp)) AS BIGINT)) AS steps FROM x)
SELECT p_partkey, steps, round(abs(dp * spp * steps - b) / b, 9) AS error, array_to_string(list_filter([CASE WHEN abs(dp * spp * steps - b) / b > 0.05 THEN 'center_error' END, CASE WHEN dp * p99 > b THEN 'microstep_p99' END], lambda x: x IS NOT NULL), ',') AS reasons FROM y""")
def batch_contract(t):
    c = N.batch_contract(F.lit(128), F.pow(F.lit(2), F.col("p_size") % 3).cast("long"), F.col("p_size") / 10.0 + 1, F.col("p_size") * 3 + 40.0, 0.05)
    return t.part.select("p_partkey", c["steps"].alias("steps"), F.round(c["error"], 9).alias("error"), F.array_join(c["reasons"], ",").alias("reasons"))


@query("""SELECT o_orderkey, round(1000 / o_totalprice, 12) AS seconds, round(1000 / o_totalprice * 4 / 3600, 15) AS gpu_hours FROM orders""")
def per_thousand_samples(t):
    c = N.per_thousand(F.col("o_totalprice"), F.lit(4))
    return t.orders.select("o_orderkey", F.round(c["seconds"], 12).alias("seconds"), F.round(c["gpu_hours"], 15).alias("gpu_hours"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND (p_size + 2) % 2 = 0 THEN (1 + p_partkey % 3) * (p_size // 2) * ((p_size + 2) // 2) END AS tokens, CASE WHEN (p_size * 14) % 28 = 0 THEN p_size END AS grid_h FROM part""")
def visual_tokens(t):
    grid = N.pixel_grid(F.col("p_size") * 14, F.col("p_size") * 14)
    return t.part.select("p_partkey", N.grid_tokens(F.col("p_partkey") % 3 + 1, F.col("p_size"), F.col("p_size") + 2).alias("tokens"), grid["h"].alias("grid_h"))


@query("""WITH x AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'NaN' WHEN 'error' THEN 'Infinity' WHEN 'view' THEN 'abc' ELSE CAST(value - 100 AS VARCHAR) END AS s, event_type, value FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'error', 'view') THEN NULL ELSE round(value - 100, 6) END AS finite, CASE WHEN event_type IN ('click', 'error', 'view') OR value - 100 <= 0 THEN NULL ELSE round(value - 100, 6) END AS positive FROM x""")
def finite_values(t):
    s = F.expr("CASE event_type WHEN 'click' THEN 'NaN' WHEN 'error' THEN 'Infinity' WHEN 'view' THEN 'abc' ELSE CAST(value - 100 AS STRING) END")
    return t.events.withColumn("s", s).select("event_id", F.round(N.finite(F.col("s")), 6).alias("finite"), F.round(N.positive(F.col("s")), 6).alias("positive"))


@query("""SELECT p_brand, round(avg(p_retailprice), 4) AS mean, max(p_size) AS most, avg(p_retailprice) <= 960 AND max(p_size) >= 49 AND min(p_retailprice) > 900 AS passed FROM part GROUP BY p_brand""")
def gates(t):
    per = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.max("p_size").alias("most"), F.min("p_retailprice").alias("least"))
    tests = [N.gate("mean", F.col("m"), "<=", 960), N.gate("size", F.col("most"), ">=", 49), N.gate("least", F.col("least"), ">", 900)]
    return per.select("p_brand", F.round("m", 4).alias("mean"), "most", N.all_pass(tests).alias("passed"))


@query("""WITH x AS (SELECT p_partkey, p_size * 0.75 AS v FROM part), b AS (SELECT *, coalesce(list_max(list_filter([1, 2, 4, 8, 16, 32], lambda g: g <= v)), 1) AS low, coalesce(list_min(list_filter([1, 2, 4, 8, 16, 32], lambda g: g >= v)), 32) AS high FROM x),
w AS (SELECT *, CASE WHEN low = high THEN 0 ELSE ln(v / low) / ln(high / low) END AS weight FROM b) SELECT p_partkey, low, high, round(weight, 9) AS weight, v < 1 OR v > 32 AS extrapolated, round(exp((1 - weight) * ln(low * 3.0) + weight * ln(high * 5.0)), 7) AS value FROM w""")
def log_bracket(t):
    out = t.part.select("p_partkey", N.bracket(F.col("p_size") * 0.75, [1, 2, 4, 8, 16, 32]).alias("b")).select("p_partkey", "b.*")
    return out.withColumn("value", F.round(N.log_interpolate(F.col("low") * 3.0, F.col("high") * 5.0, F.col("weight")), 7)).withColumn("weight", F.round("weight", 9))


@query("""WITH x AS (SELECT p_partkey, p_size AS n, p_size // 4 AS f FROM part) SELECT p_partkey, f AS "full", n - f AS linear, n * 64 * 128 * 3 AS mlp_work, (n - f) * 64 * 260 AS linear_work, 0 AS unknown FROM x""")
def layer_structure(t):
    kinds = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.when(i % 4 == 0, "full_attention").otherwise("linear_attention"))
    w = N.layer_work(kinds, F.lit(64), F.lit(128))
    return t.part.select("p_partkey", *(c.alias(k) for k, c in w.items()))


@query("""WITH x AS (SELECT p_partkey, p_size::BIGINT AS d, p_size::BIGINT * 16 AS h, 256::BIGINT AS i, 3584::BIGINT AS o, p_partkey % 2 = 0 AS gated FROM part),
y AS (SELECT *, CASE WHEN gated THEN h ELSE 8 * h END + 16 * h * h + 4 * h + 4 * h * o + o AS merger, 3 * h * h + 3 * h + h * h + h AS attention, CASE WHEN gated THEN 2 * (i * h + i) + h * i + h ELSE h * i + i + i * h + h END AS mlp FROM x)
SELECT p_partkey, 3 * h * 2 * 14 * 14 AS patch_embed, d * (attention + mlp + CASE WHEN gated THEN 2 * h ELSE 4 * h END) AS blocks, merger, CASE WHEN gated THEN 0 ELSE 2304 * h END AS positions, CASE WHEN gated THEN 0 ELSE 3 * merger END AS tap_mergers,
3 * h * 2 * 14 * 14 + d * (attention + mlp + CASE WHEN gated THEN 2 * h ELSE 4 * h END) + merger + CASE WHEN gated THEN 0 ELSE 2304 * h + 3 * merger END AS total, ((100 + d * 7) // 14) * ((50 + d * 9) // 14) // 4 AS tokens FROM y""")
def vision_tower(t):
    size, gated = F.col("p_size").cast("long"), F.col("p_partkey") % 2 == 0
    plain = F.when(gated, 0).otherwise(1)
    c = N.vision_tower(depth=size, hidden=size * 16, inner=256, out=3584, positions=plain * 2304, taps=plain * 3, gated=gated)
    return t.part.select("p_partkey", *(v.alias(k) for k, v in c.items()), N.picture_tokens(size * 7 + 100, size * 9 + 50).alias("tokens"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_partkey * 2000 // 4 + p_size * 4000 ELSE 0 END AS workspace FROM part""")
def gather_workspace(t):
    return t.part.select("p_partkey", N.gather_workspace(F.col("p_partkey") * 1000, F.col("p_size").cast("long") * 1000, F.lit(4), F.col("p_partkey") % 4).alias("workspace"))


@query("""SELECT source, array_to_string(list_filter([CASE WHEN max(n_chars) > 15000 THEN 'max_exceeds_declared' END, CASE WHEN abs(avg(n_chars) - 2400) > 120 THEN 'mean_differs' END], lambda x: x IS NOT NULL), ',') AS warnings,
CASE WHEN count(*) >= 48 THEN 'feasible' WHEN count(*) >= 40 THEN 'shorten' ELSE 'infeasible' END AS feasibility, CASE WHEN source IN ('src0', 'src1') THEN 'supported' WHEN source IN ('src2', 'src3') THEN 'partial' ELSE 'unsupported' END AS support FROM documents GROUP BY source""")
def length_alignment(t):
    per = t.documents.groupBy("source").agg(F.max("n_chars").alias("m"), F.avg("n_chars").alias("a"), F.count("*").alias("n"))
    warnings = N.length_warnings(F.lit(15000), F.lit(2400.0), F.col("m"), F.col("a"))
    return per.select("source", F.array_join(warnings, ",").alias("warnings"), N.enough_samples(F.col("n"), F.lit(8), F.lit(4), F.lit(2)).alias("feasibility"), N.support_class(F.col("source"), ["src0", "src1", "src2"], ["src0", "src1", "src3"]).alias("support"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN CAST(round_even(round(value, 2) * 1048576, 0) AS BIGINT) WHEN 'click' THEN CAST(round_even(round(value, 2) * 1073741824, 0) AS BIGINT) END AS requested FROM events""")
def oom_parse(t):
    message = F.expr("CASE event_type WHEN 'error' THEN concat('CUDA: tried to ALLOCATE ', format_string('%.2f', value), ' MiB.') WHEN 'click' THEN concat('tried to allocate ', format_string('%.2f', value), ' gib') ELSE 'fine' END")
    return t.events.select("event_id", T.memory_amount(message, "tried to allocate").alias("requested"))


_HEADS = ["preflight-", "h800val-", "smoke-", "mem-", "packmem-", "packon-", "prof-", "scale-", "tput-", "tputd-", "run-", "x-mem-"]
_KINDS = ["", "thermal_validation", "memory_probe", "profiler", "throughput_screen", "packing_memory_probe", "smoke", "else"]


@query(f"""WITH j AS (SELECT o_orderkey, concat({_HEADS}[1 + o_orderkey % 12], o_orderkey) AS id, {_KINDS}[1 + o_custkey % 8] AS kind, CASE WHEN o_orderkey % 31 = 0 THEN 'given' END AS given, o_orderkey % 17 = 0 AS probe, o_orderkey % 13 = 0 AS pair FROM orders)
SELECT o_orderkey, CASE WHEN given IS NOT NULL THEN given WHEN probe THEN 'memory' WHEN pair THEN 'packing' WHEN id LIKE 'preflight-%' THEN 'preflight' WHEN kind = 'thermal_validation' OR id LIKE 'h800val-%' OR kind = 'smoke' OR id LIKE 'smoke-%' THEN 'validation'
WHEN kind IN ('memory_boundary', 'memory_probe') OR id LIKE 'mem-%' THEN 'memory' WHEN kind = 'packing_memory_probe' OR id LIKE 'packmem-%' OR id LIKE 'packon-%' OR id LIKE 'packoff-%' THEN 'packing' WHEN kind = 'profiler' OR id LIKE 'prof-%' THEN 'profiler'
WHEN id LIKE 'scale-%' THEN 'scaling' WHEN id LIKE 'tput-%' OR id LIKE 'tputscreen-%' OR id LIKE 'tputd-%' OR kind IN ('throughput', 'throughput_screen') THEN 'throughput' ELSE 'other' END AS phase FROM j""")
def phase_case(t):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    key = F.col("o_orderkey")
    phase = T.job_phase(F.concat(pick(_HEADS, "o_orderkey"), key.cast("string")), pick(_KINDS, "o_custkey"), F.when(key % 31 == 0, "given"), key % 17 == 0, key % 13 == 0)
    return t.orders.select("o_orderkey", phase.alias("phase"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN event_id % 3 = 1 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS at,
CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL WHEN 'purchase' THEN round(value) * 100000 ELSE round(value, 2) END AS amount, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS flag FROM events""")
def telemetry_rows(t):
    text = F.when(F.col("event_id") % 3 == 2, "bad").when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS"))
    whole = F.round("value").cast("long").cast("string")
    amount = F.when(F.col("event_type") == "error", "[N/A]").when(F.col("event_type") == "signup", F.format_string("%.2f W", "value")).when(F.col("event_type") == "purchase", F.concat(whole, F.lit("e5"))).otherwise(F.format_string(" %.2f ", "value"))
    flag = F.when(F.col("event_type") == "view", "Active").when(F.col("event_type") == "click", "Not Active").otherwise("N/A")
    at = T.telemetry_time(text, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t.events.select("event_id", at.cast("timestamp_ntz").alias("at"), T.maybe_number(amount).alias("amount"), T.maybe_flag(flag).alias("flag"))


@query("""SELECT c_custkey, concat('run-', substr(sha256(concat('{"key":', c_custkey, ',"model":"', c_name, '","note":', CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"é' || c_nationkey || '"' END, '}')), 1, 16)) AS id FROM customer""")
def stable_ids(t):
    note = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("é"), F.col("c_nationkey").cast("string")))
    return t.customer.select("c_custkey", T.stable_id("run", model=F.col("c_name"), note=note, key=F.col("c_custkey")).alias("id"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"n":' || CAST(event_id AS VARCHAR) || '}' AS encoded FROM events""")
def json_props(t):
    parsed = F.from_json("props", "k bigint")
    return t.events.select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("n"))).alias("encoded"))


@query("""SELECT n_nationkey, list_sum([0, 2] || range(4, 8)) + n_nationkey AS total, format('{:.3f}%', n_nationkey / 7.0 * 100) AS share FROM nation""")
def index_lists(t):
    ids = T.index_list(F.lit("0, 2,4-7"))
    return t.nation.select("n_nationkey", (F.aggregate(ids, F.lit(0), lambda a, x: a + x) + F.col("n_nationkey")).cast("long").alias("total"), T.percent(F.col("n_nationkey") / 7.0).alias("share"))


_CATEGORY = "CASE WHEN quantile_cont(n, 0.9) <= 512 THEN 'short' WHEN quantile_cont(n, 0.99) / greatest(quantile_cont(n, 0.5), 1) >= 1.75 THEN 'longtail' WHEN quantile_cont(n, 0.5) >= 8192 THEN 'longcontext' ELSE 'multiturn' END"


@query(f"""SELECT l_suppkey, scale, {_CATEGORY} AS category FROM (SELECT l_suppkey, scale, 1000 * scale + l_quantity * scale AS n FROM lineitem, (SELECT unnest([0.1::DOUBLE, 1, 5, 10]) AS scale) UNION ALL SELECT l_suppkey, 0::DOUBLE, l_quantity * 40 FROM lineitem) GROUP BY l_suppkey, scale""")
def category_infer(t):
    scaled = t.lineitem.select("l_suppkey", F.explode(F.array(*map(F.lit, (0.1, 1.0, 5.0, 10.0)))).alias("scale"), "l_quantity").select("l_suppkey", "scale", (F.col("scale") * 1000 + F.col("l_quantity") * F.col("scale")).alias("n"))
    rows = scaled.unionByName(t.lineitem.select("l_suppkey", F.lit(0.0).alias("scale"), (F.col("l_quantity") * 40).alias("n")))
    p = {q: S.percentile("n", q / 100) for q in (50, 90, 99)}
    return rows.groupBy("l_suppkey", "scale").agg(T.length_category(p[50], p[90], p[99]).alias("category"))


@query("""WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, string_agg(concat(o_orderstatus, '=', n), ',' ORDER BY o_orderstatus) AS counts FROM g GROUP BY o_orderpriority""")
def count_maps(t):
    m = A.counts_by(t.orders, ["o_orderpriority"], "o_orderstatus")
    return m.select("o_orderpriority", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0) AS best FROM orders GROUP BY o_custkey""")
def distinct_sets(t):
    best = A.first_present(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), F.lit(0.0))
    return t.orders.groupBy("o_custkey").agg(F.array_join(A.distinct_sorted("o_orderpriority"), ",").alias("priorities"), best.alias("best"))


_CONV = """o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 'system' AS sys FROM conversations),
p AS (SELECT *, CASE WHEN sys THEN i - 1 ELSE i END AS j FROM o)"""


@query(f"""WITH {_CONV} SELECT conv_id, count_if(j > 0) > 0 AND count_if(j > 0) % 2 = 0 AND coalesce(bool_and(CASE WHEN j > 0 THEN coalesce(role = CASE WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END AND length(trim(text)) > 0, false) END), true) AS valid FROM p GROUP BY conv_id""")
def conversation_valid(t):
    rows = A.conversations(t.conversations, "conv_id", "turn", "role", "text")
    return rows.select("conv_id", A.valid_conversation(F.col("messages")).alias("valid"))


_PIECES = r"len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}|[^\s\p{L}\p{N}]+'))"


@query(f"""SELECT conv_id, count(*) AS turns, count_if(role = 'assistant') AS assistant_turns, CAST(sum({_PIECES}) AS BIGINT) AS tokens, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN {_PIECES} END), 0) AS BIGINT) AS label_tokens FROM conversations GROUP BY conv_id""")
def turn_profile(t):
    rows = A.conversations(t.conversations, "conv_id", "turn", "role", "text")
    return rows.select("conv_id", *(c.cast("long").alias(k) for k, c in A.turn_profile(F.col("messages")).items()))


@query(rf"""WITH o AS (SELECT conv_id, role, coalesce(text, '') AS t, text IS NULL AS none, {_PIECES} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
l AS (SELECT *, CASE WHEN length(t) > 64 THEN len(regexp_extract_all(left(t, 64), '\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+')) ELSE n END AS low, sum(n) OVER (PARTITION BY conv_id) - 60 AS over FROM o),
g AS (SELECT *, coalesce(sum(n - low) OVER (PARTITION BY conv_id ORDER BY role NOT IN ('user', 'system'), -length(t), i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n - low) OVER (PARTITION BY conv_id) AS give FROM l),
c AS (SELECT *, greatest(0, least(over - before, n - low)) AS cut FROM g)
SELECT conv_id, max(over) <= max(give) AS fits, CASE WHEN max(over) <= max(give) THEN CAST(sum(n - cut) AS BIGINT) END AS tokens FROM c GROUP BY conv_id""")
def conversation_crop(t):
    rows = A.conversations(t.conversations, "conv_id", "turn", "role", "text")
    cut = rows.withColumn("messages", A.capped(F.col("messages"), 60))
    return cut.select("conv_id", F.col("messages").isNotNull().alias("fits"), F.when(F.col("messages").isNotNull(), A.turn_profile(F.col("messages"))["tokens"].cast("long")).alias("tokens"))


@query("""SELECT p_brand, count(*) AS images, CAST(sum(p_size * k) AS BIGINT) AS tokens, quantile_cont(p_size * k, 0.5) AS p50, max(p_size * k) AS most FROM part, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= 1 + p_partkey % 3 GROUP BY p_brand""")
def media_profile(t):
    images = F.transform(F.sequence(F.lit(1).cast("long"), F.col("p_partkey") % 3 + 1), lambda k: F.struct((F.col("p_size") * k).alias("tokens")))
    return A.media_profile(t.part.withColumn("images", images), ["p_brand"], "images")


def _exchanges(t):
    """Conversations with their turns in order, as messages."""
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def token_profile(t):
    """Turns and tokens of each conversation by a tokenizer; SQL can't run one."""
    return tokens.token_profile(_exchanges(t), _vocabulary(), template=tokens.CHAT).drop("messages")


@query()
def token_capped(t):
    """Conversations cut to 600 tokens by a tokenizer."""
    out = tokens.capped_to_tokens(_exchanges(t), 600, _vocabulary(), template=tokens.CHAT)
    return out.select("conv_id", "transformation", "original_tokens", "reference_tokens_after_crop", F.sha2(F.to_json("messages"), 256).alias("messages_sha256"))


def _samples(t):
    """Parts as samples of one to three pictures, some with a grid, some of a size that is no multiple of patches."""
    key, size = F.col("p_partkey"), F.col("p_size")
    image = lambda k: F.struct(
        F.when(key % 4 == 0, F.array(F.lit(1), size * 2, k * 2)).alias("grid_thw"), (size * 28 + F.when(key % 31 == 0, 1).otherwise(0)).alias("width"), (k * 28).alias("height"), F.lit(None).cast("long").alias("frames"),
        F.when(key % 5 == 0, size * k + F.when(key % 35 == 0, 1).otherwise(0)).alias("visual_tokens"), F.lit(None).cast("long").alias("pixels"),
    )
    # a small file would leave this to a few tasks
    return t.part.repartition("p_partkey").select(
        key.alias("sample_id"), F.when(key % 3 > 0, F.col("p_brand")).alias("task_family"), F.transform(F.sequence(F.lit(1).cast("long"), key % 3 + 1), image).alias("images"), F.when(key % 2 == 0, key % 400).alias("text_tokens"),
        (key % 300 + 5).alias("padded_tokens"), (key % 60).alias("label_tokens"), F.lit(None).cast("long").alias("repeated_prompt_tokens"),
    )


_SAMPLES = """s AS (SELECT p_partkey AS k, p_size AS z, 1 + p_partkey % 3 AS n, CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'causal_vl_sft' END AS task_family, CAST(p_partkey % 60 AS BIGINT) AS label FROM part),
r AS (SELECT *, n AS image_count, CAST(z * n * (n + 1) // 2 AS BIGINT) AS visual, CASE WHEN k % 2 = 0 THEN k % 400 ELSE k % 300 + 5 - n END AS txt, CASE WHEN k % 4 > 0 AND k % 31 = 0 THEN 'patches' WHEN k % 35 = 0 THEN 'declared' END AS bad FROM s),
e AS (SELECT *, coalesce(bad, CASE WHEN txt + visual < label THEN 'labels' END) AS error, CASE WHEN txt + visual > 0 THEN visual / (txt + visual) ELSE 0 END AS ratio FROM r)"""


@query(f"""WITH {_SAMPLES} SELECT CAST(k AS VARCHAR) AS sample_id, task_family, image_count, CASE WHEN error IS DISTINCT FROM 'patches' THEN visual END AS visual_tokens_total, txt AS text_tokens, CASE WHEN error IS DISTINCT FROM 'patches' THEN round(ratio, 9) END AS image_token_ratio, error FROM e""")
def media_records(t):
    rows, sized = M.media_records(_samples(t)), F.coalesce(F.col("error") != "patches", F.lit(True))
    return rows.select("sample_id", "task_family", "image_count", F.when(sized, F.col("visual_tokens_total")).alias("visual_tokens_total"), "text_tokens", F.when(sized, F.round("image_token_ratio", 9)).alias("image_token_ratio"), "error")


_STATS = "count(*) AS n, round(min(v), 9) AS least, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS p50, round(quantile_cont(v, 0.9), 9) AS p90, round(quantile_cont(v, 0.95), 9) AS p95, round(quantile_cont(v, 0.99), 9) AS p99, round(max(v), 9) AS most"


@query(f"""WITH {_SAMPLES}, g AS (SELECT * FROM e WHERE error IS NULL),
f AS (SELECT task_family, 'image_count' AS field, CAST(image_count AS DOUBLE) AS v FROM g UNION ALL SELECT task_family, 'visual_tokens_total', visual FROM g UNION ALL SELECT task_family, 'text_tokens', txt FROM g UNION ALL SELECT task_family, 'label_tokens', label FROM g
UNION ALL SELECT task_family, 'repeated_prompt_tokens', 0 FROM g UNION ALL SELECT task_family, 'total_tokens', txt + visual FROM g UNION ALL SELECT task_family, 'image_token_ratio', ratio FROM g UNION ALL SELECT task_family, 'visual_tokens_per_image', z * i FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM g))
SELECT task_family, field, {_STATS} FROM f GROUP BY task_family, field UNION ALL SELECT 'all', field, {_STATS} FROM f GROUP BY field""")
def media_summary(t):
    """Distributions of all fields by task and over all records."""
    values = materialise(M.media_values(M.media_records(_samples(t)), ["task_family"]), "values")
    both = M.summary_of(values, ["task_family"]).unionByName(M.summary_of(values).withColumn("task_family", F.lit("all")))
    return both.select("task_family", "field", "n", *(F.round(c, 9).alias({"min": "least", "max": "most"}.get(c, c)) for c in ("min", "mean", "p50", "p90", "p95", "p99", "max")))
