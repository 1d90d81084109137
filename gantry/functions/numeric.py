"""Closed-form quantities of training configurations, as Columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gantry.functions.stats import rate


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def aligned_cutoff(x: Column, step: int = 512) -> Column:
    """Up to the next multiple of the step, at least one."""
    return F.greatest(F.lit(step).cast("long"), F.ceil(x / step).cast("long") * step)


def accumulation(batch: Column, cards: Column, micro: Column) -> Column:
    """Accumulation steps whose global batch is nearest to the target; ties to fewer."""
    per = cards * micro
    low = F.greatest(F.lit(1).cast("long"), F.floor(batch / per).cast("long"))
    high = F.greatest(F.lit(1).cast("long"), F.ceil(batch / per).cast("long"))
    return F.when(F.abs(per * low - batch) <= F.abs(per * high - batch), low).otherwise(high)


def exact_accumulation(batch: Column, cards: Column, micro: Column) -> Column:
    """Accumulation steps that meet the target exactly, else null."""
    per = cards * micro
    return F.when((per > 0) & (per <= batch) & (batch % per == 0), (batch / per).cast("long"))


def forward_parts(tokens: Column, pairs: Column, *, hidden, inner, layers, query, kv, vocab, rank=32) -> dict[str, Column]:
    """Operations of one forward pass, in doubles as long integers overflow: two for each multiply and add."""
    hidden, inner, layers, query, kv, vocab = (lit(x).cast("double") for x in (hidden, inner, layers, query, kv, vocab))
    projections = hidden * (query + kv * 2) * 2 + query * hidden * 2
    adapters = hidden * 9 + kv * 2 + inner * 3
    return {
        "linear": layers * (projections + hidden * inner * 6) * tokens,
        "attention": layers * query * 2 * pairs,
        "head": hidden * vocab * 2 * tokens,
        "adapter": layers * 2 * lit(rank).cast("double") * adapters * tokens,
    }


def training_operations(mode: Column, parts: Mapping[str, Column]) -> Column:
    """Forward and backward: three passes in full training; frozen weights take two, adapters and attention three."""
    full = (parts["linear"] + parts["attention"] + parts["head"]) * 3.0
    adapted = parts["linear"] * 2.0 + parts["attention"] * 3.0 + parts["head"] * 2.0 + parts["adapter"] * 3.0
    return F.when(mode == "full", full).when(mode == "lora", adapted)


def sequence_pairs(lengths: Column) -> Column:
    """Sum of squared lengths of the sequences in an array."""
    return F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x.cast("double") * x)


def utilisation(operations: Column, seconds: Column, cards: Column, peak) -> Column:
    return rate(operations, seconds * cards * lit(peak))


def clock_adjusted(mfu: Column, ratio: Column) -> Column:
    return rate(mfu, ratio)


def state_floor(parameters: Column, trainable: Column, cards: Column, stage: Column, weight_bytes: int = 2, optimizer_bytes: int = 12) -> Column:
    """Least bytes of weights and optimizer on a card: stage 1 shards the optimizer, stage 3 the weights too."""
    weights, optimizer = parameters * weight_bytes, trainable * optimizer_bytes
    whole = lambda a, b: F.floor(a / b).cast("long")
    return F.when(stage >= 3, whole(weights, cards) + whole(optimizer, cards)).when(stage >= 1, weights + whole(optimizer, cards)).otherwise(weights + optimizer)


#: Bytes of a weight, a gradient, the optimizer's state of a weight, a communicated gradient and a logit: fixed values.
WEIGHT, GRADIENT, OPTIMIZER, EXCHANGED, LOGIT = 2.0, 2.0, 12.0, 2.0, 4.0
#: Elements of the buckets for reductions, gathers and prefetches, and of weights kept live and for reuse: fixed values.
REDUCE_BUCKET, GATHER_BUCKET, PREFETCH_BUCKET, MAX_LIVE, MAX_REUSE = 5e8, 5e8, 5e7, 1e9, 1e9
#: How much of the structural activations may be live at once, least and most.
LIVENESS = (0.25, 4.0)


def _sharded(x: Column, stage: Column, from_stage: int, cards: Column) -> Column:
    return F.when(stage >= from_stage, x / cards).otherwise(x)


def _layer_width(g: Mapping[str, Column]) -> Column:
    """Activations of a token in a layer."""
    return g["hidden"] * 6 + g["kv"] * 2 + g["inner"] * 3


def memory_components(g: Mapping[str, Column], *, cards: Column, micro: Column, cutoff: Column, stage: Column, checkpointing: Column) -> dict[str, Column]:
    """The nine components of a card's memory in bytes.

    `g` is the model's geometry: loaded and trainable parameters, hidden, inner, kv, layers, heads, vocab, and the
    elements of its largest module (`module`) and of its persistent tensors (`persistent`).
    """
    g = {k: lit(v).cast("double") for k, v in g.items()}
    cards, tokens = lit(cards).cast("double"), (lit(micro) * lit(cutoff)).cast("double")
    reduce = F.least(g["trainable"], F.lit(REDUCE_BUCKET)) * GRADIENT
    gather = F.least(g["trainable"], F.lit(GATHER_BUCKET)) * WEIGHT
    kept = F.least(g["loaded"], F.lit(MAX_LIVE + MAX_REUSE))
    live = F.least(g["loaded"], kept + g["module"] + g["persistent"])
    width = _layer_width(g)
    return {
        "parameters": _sharded(g["loaded"] * WEIGHT, stage, 3, cards),
        "gradients": _sharded(g["trainable"] * GRADIENT, stage, 2, cards),
        "optimizer": _sharded(g["trainable"] * OPTIMIZER, stage, 1, cards),
        "saved": tokens * g["layers"] * F.when(checkpointing, g["hidden"]).otherwise(width) * WEIGHT,
        "recompute": F.when(checkpointing, tokens * width * WEIGHT).otherwise(0.0),
        "attention": tokens * (g["hidden"] * 2 + g["kv"] * 2) * WEIGHT + tokens * g["heads"] * 4,
        "logits": tokens * g["vocab"] * LOGIT,
        "collective": F.when(stage == 2, F.greatest(reduce, gather)).when(stage >= 1, reduce).otherwise(0.0),
        "live": F.when((stage >= 3) & (cards > 1), live * WEIGHT * (1 - 1 / cards)).otherwise(0.0),
    }


def memory_reference(c: Mapping[str, Column]) -> dict[str, Column]:
    """Sum of the components, their share that is no activation, and the lower bound under the least liveness."""
    activation = c["saved"] + c["recompute"] + c["attention"]
    rest = c["parameters"] + c["gradients"] + c["optimizer"] + c["logits"] + c["collective"] + c["live"]
    return {"reference": rest + activation, "non_activation": rest, "lower_bound": rest + activation * LIVENESS[0]}


def phase_peak(persistent: Column, common: Column, language: Column, vision: Column) -> Column:
    """Phases follow one another: the larger of both, never their sum."""
    return persistent + common + F.greatest(language, vision)


def performance_basis(g: Mapping[str, Column], *, mode: Column, tokens: Column, pairs: Column, cards: Column, stage: Column, checkpointing: Column, accumulation: Column, peak: float, memory_bandwidth: float, link_bandwidth: float) -> dict[str, Column]:
    """Work, traffic and exchange of a step and the seconds they take at best.

    `g` is the geometry with `linear` (applications of a weight in a pass), `adapter` parameters, loaded and trainable
    parameters, hidden, inner, kv and layers. `tokens` and `pairs` are computed tokens and attention pairs of a step.
    """
    g = {k: lit(v).cast("double") for k, v in g.items()}
    tokens, pairs, cards, steps = (lit(x).cast("double") for x in (tokens, pairs, cards, accumulation))
    full = mode == "full"
    square = g["layers"] * g["hidden"] * pairs
    operations = {
        "linear": F.when(full, g["linear"] * 6 * tokens).otherwise((g["linear"] * 4 + g["adapter"] * 6) * tokens),
        "attention": square * 6,
        "recompute_linear": F.when(checkpointing, (g["linear"] + F.when(full, 0.0).otherwise(g["adapter"])) * 2 * tokens).otherwise(0.0),
        "recompute_attention": F.when(checkpointing, square * 2).otherwise(0.0),
    }
    total = functools.reduce(operator.add, operations.values())
    local = tokens / cards
    activations, attention = local * g["layers"] * _layer_width(g) * WEIGHT * 4, local * (g["hidden"] + g["kv"]) * 2 * WEIGHT * 4
    weights = steps * (g["linear"] + g["adapter"]) * WEIGHT * 2
    kernel = weights + (activations + attention) * F.when(checkpointing, 3.0).otherwise(1.0)
    optimizer = g["trainable"] / cards * (WEIGHT + GRADIENT + OPTIMIZER) * 2
    ring, passes = (cards - 1) / cards, F.when(checkpointing, 3.0).otherwise(2.0)
    reduced, updated = g["trainable"] * EXCHANGED, g["trainable"] * WEIGHT
    several = cards > 1
    payload = (
        F.when(~several | (stage < 1), 0.0).when(stage == 1, ring * (reduced * 2 + updated)).when(stage == 2, ring * (steps * reduced * 2 + updated))
        .otherwise(ring * steps * (passes * g["loaded"] * WEIGHT + reduced))
    )
    reductions, gathers = F.ceil(g["trainable"] / REDUCE_BUCKET), F.ceil(g["trainable"] / GATHER_BUCKET)
    collectives = (
        F.when(~several | (stage < 1), 0.0).when(stage == 1, reductions + gathers).when(stage == 2, steps * reductions + gathers)
        .otherwise(steps * (passes * F.ceil(g["loaded"] / PREFETCH_BUCKET) + reductions))
    )
    return operations | {
        "operations": total, "weights": weights, "activations": activations, "attention_traffic": attention, "kernel": kernel, "optimizer": optimizer,
        "payload": payload, "collectives": collectives.cast("long"), "compute_seconds": total / (cards * peak), "kernel_seconds": kernel / memory_bandwidth,
        "optimizer_seconds": optimizer / memory_bandwidth, "payload_seconds": payload / link_bandwidth,
    }


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bounded(x: Column, limit: float) -> Column:
    return F.tanh(x / F.lit(limit)) * limit


def roofline(compute: Column, traffic: Column, p: float, correction: Column, limit: float) -> Column:
    """A smooth maximum of two times with a bounded correction in the log."""
    return F.pow(F.pow(compute, p) + F.pow(traffic, p), 1.0 / p) * F.exp(bounded(correction, limit))


def batch_contract(target: Column, parallel: Column, per_pack: Column, p99: Column, most_error: float) -> dict[str, Column]:
    """Packs for a target batch: accumulation, the centre's relative error and what speaks against it."""
    steps = F.greatest(F.lit(1).cast("long"), F.round(target / (parallel * per_pack)).cast("long"))
    error = F.abs(parallel * per_pack * steps - target) / target
    reasons = F.array_compact(F.array(F.when(error > most_error, F.lit("center_error")), F.when(parallel * p99 > target, F.lit("microstep_p99"))))
    return {"steps": steps, "error": error, "reasons": reasons}


def per_thousand(samples_per_second: Column, cards: Column) -> dict[str, Column]:
    seconds = rate(F.lit(1000.0), samples_per_second)
    return {"seconds": seconds, "gpu_hours": seconds * cards / 3600}


def grid_tokens(t: Column, h: Column, w: Column, merge: int = 2) -> Column:
    """Visual tokens of a grid; null unless both sides divide."""
    return F.when((h % merge == 0) & (w % merge == 0) & (t > 0), t * (h / merge).cast("long") * (w / merge).cast("long"))


def pixel_grid(width: Column, height: Column, patch: int = 14, merge: int = 2) -> Column:
    """Patches of a picture, or null where the sides don't divide by merged patches."""
    unit = patch * merge
    ok = (width % unit == 0) & (height % unit == 0) & (width > 0) & (height > 0)
    return F.when(ok, F.struct((height / patch).cast("long").alias("h"), (width / patch).cast("long").alias("w")))


def finite(x: Column) -> Column:
    """As a double, null unless finite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def positive(x: Column) -> Column:
    d = finite(x)
    return F.when(d > 0, d)


def gate(name: str, actual: Column, comparator: str, threshold: float) -> Column:
    """struct(name, actual, comparator, threshold, passed)."""
    tests = {"<=": actual <= threshold, "<": actual < threshold, ">=": actual >= threshold, ">": actual > threshold, "==": actual == threshold}
    return F.struct(F.lit(name).alias("name"), actual.cast("double").alias("actual"), F.lit(comparator).alias("comparator"), F.lit(float(threshold)).alias("threshold"), F.coalesce(tests[comparator], F.lit(False)).alias("passed"))


def all_pass(gates: Sequence[Column]) -> Column:
    return F.forall(F.array(*gates), lambda g: g["passed"])


def bracket(value: Column, grid: Sequence[int]) -> Column:
    """struct(low, high, weight, extrapolated): neighbours on a grid and the weight of the upper one in the log."""
    points = F.array(*map(F.lit, grid))
    low = F.coalesce(F.array_max(F.filter(points, lambda x: x <= value)), F.lit(min(grid)))
    high = F.coalesce(F.array_min(F.filter(points, lambda x: x >= value)), F.lit(max(grid)))
    weight = F.when(low == high, 0.0).otherwise(F.log(value / low) / F.log(high / low))
    return F.struct(low.alias("low"), high.alias("high"), weight.alias("weight"), ((value < min(grid)) | (value > max(grid))).alias("extrapolated"))


def log_interpolate(low: Column, high: Column, weight: Column) -> Column:
    return F.exp((1 - weight) * F.log(low) + weight * F.log(high))


def layer_work(kinds: Column, hidden: Column, inner: Column, kernel: int = 4) -> dict[str, Column]:
    """Full and linear attention layers of an array of kinds and their multiply counts for a token."""
    full = F.size(F.filter(kinds, lambda k: k == "full_attention")).cast("long")
    linear = F.size(F.filter(kinds, lambda k: k == "linear_attention")).cast("long")
    return {"full": full, "linear": linear, "mlp_work": (full + linear) * hidden * inner * 3, "linear_work": linear * hidden * (hidden * 4 + kernel), "unknown": F.size(kinds) - full - linear}


def vision_tower(*, depth, hidden, inner, out, patch=14, merge=2, temporal=2, channels=3, positions=0, taps=0, gated=False) -> dict[str, Column]:
    """Parameters of a vision tower by part.

    Gated blocks have three projections in the feed-forward part and norms without bias; others have two, norms with
    bias, learned positions and one more merger for each tap.
    """
    depth, hidden, inner, out, patch, merge, temporal, channels, positions, taps = (lit(x).cast("long") for x in (depth, hidden, inner, out, patch, merge, temporal, channels, positions, taps))
    gated = lit(gated)
    wide = hidden * merge * merge
    merger = F.when(gated, hidden).otherwise(wide * 2) + wide * wide + wide + wide * out + out
    forward = F.when(gated, hidden * inner * 3 + inner * 2 + hidden).otherwise(hidden * inner * 2 + inner + hidden)
    parts = {
        "patch_embed": channels * hidden * temporal * patch * patch,
        "blocks": depth * (hidden * hidden * 4 + hidden * 4 + forward + F.when(gated, hidden * 2).otherwise(hidden * 4)),
        "merger": merger, "positions": hidden * positions, "tap_mergers": taps * merger,
    }
    return parts | {"total": functools.reduce(operator.add, parts.values())}


def picture_tokens(height: Column, width: Column, patch: int = 14, merge: int = 2) -> Column:
    """Visual tokens of a picture, parts of patches and of merged patches left off."""
    return F.floor(F.floor(height / patch) * F.floor(width / patch) / (merge * merge)).cast("long")


def gather_workspace(loaded: Column, largest: Column, cards: Column, stage: Column) -> Column:
    """Bytes of gathered weights at stage 3: a shard of all and two of the largest module; else none."""
    return F.when(stage >= 3, F.floor(loaded * 2 / cards) + largest * 4).otherwise(0).cast("long")


def length_warnings(declared_max: Column, declared_mean: Column, real_max: Column, real_mean: Column, tolerance: float = 0.05) -> Column:
    return F.array_compact(F.array(F.when(real_max > declared_max, F.lit("max_exceeds_declared")), F.when(F.abs(real_mean - declared_mean) > declared_mean * tolerance, F.lit("mean_differs"))))


def enough_samples(available: Column, batch: Column, warmup: Column, measured: Column) -> Column:
    need = batch * (warmup + measured)
    return F.when(available >= need, "feasible").when(available >= batch * (warmup + 1), "shorten").otherwise("infeasible")


def support_class(value: Column, strong: Sequence, weak: Sequence) -> Column:
    """In the domain of both evidences, of one, or of none."""
    a, b = value.isin(list(strong)), value.isin(list(weak))
    return F.when(a & b, "supported").when(a | b, "partial").otherwise("unsupported")
