"""Aggregations of run telemetry: rank to step to window to run to repeat to configuration to scenario."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.functions import stats as S
from gantry.operators.ordered import percentiles


def rank_reduce(rows: DataFrame, keys: Sequence[str], counters: Sequence[str], peaks: Sequence[str], warmup: str | None = None) -> DataFrame:
    """Ranks of a step as one row: counters are summed, times and memory are maxima, warm-up holds if it does on all."""
    out = [F.sum(S.zero(c)).alias(c) for c in counters] + [F.max(S.zero(c)).alias(c) for c in peaks]
    if warmup:
        out.append(S.all_true(warmup).alias(warmup))
    return rows.groupBy(*keys).agg(*out)


def rolling_window(steps: DataFrame, job: str, step: str, seconds: str, counters: Sequence[str], warmup: str, last: int = 20) -> DataFrame:
    """Totals, ratio-of-sums rates and step percentiles of a job's last measured steps; of all steps if none is measured."""
    measured = F.max(F.when(~F.col(warmup), 1).otherwise(0)).over(Window.partitionBy(job)) == 1
    usable = steps.withColumn("_any", measured).where(~F.col("_any") | ~F.col(warmup))
    recent = usable.withColumn("_turn", F.row_number().over(Window.partitionBy(job).orderBy(F.col(step).desc()))).where(F.col("_turn") <= last)
    out = recent.groupBy(job).agg(
        F.count("*").alias("window_steps"),
        F.sum(seconds).alias("window_seconds"),
        S.percentile(seconds, 0.5).alias("p50"),
        S.percentile(seconds, 0.9).alias("p90"),
        *(F.sum(c).alias(c) for c in counters),
    )
    return out.select("*", *(S.rate(c, "window_seconds").alias(f"{c}_rate") for c in counters))


def rank_totals(rows: DataFrame, job: str, rank: str, seconds: str, counters: Sequence[str], memory: str, counted: Column) -> DataFrame:
    """Two levels: seconds summed by rank and then the slowest rank; work summed; peak memory over all rows, counted or not."""
    per_rank = rows.groupBy(job, rank).agg(
        F.sum(F.when(counted, F.col(seconds))).alias("_s"), F.max(memory).alias("_m"), *(S.total_or_null(F.when(counted, F.col(c))).alias(c) for c in counters)
    )
    return per_rank.groupBy(job).agg(F.max("_s").alias("seconds"), F.max("_m").alias("peak"), F.count("*").alias("ranks"), *(F.sum(c).alias(c) for c in counters))


def repeats(rows: DataFrame, keys: Sequence[str], status: str, statuses: Sequence[str], metrics: Sequence[str], success: str) -> DataFrame:
    """Repeats of a configuration: counts by status; median, extremes and variation of each metric over successes."""
    good = F.col(status) == success
    out = [F.count("*").alias("runs"), *(F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses)]
    for m in metrics:
        x = F.when(good, F.col(m))
        out += [S.median(x).alias(f"{m}_median"), F.min(x).alias(f"{m}_min"), F.max(x).alias(f"{m}_max"), S.variation(x).alias(f"{m}_cv")]
    return rows.groupBy(*keys).agg(*out)


def complete_sets(planned: DataFrame, runs: DataFrame, keys: Sequence[str], job: str, repeat: str, ok: Column) -> DataFrame:
    """Whether the successful runs of a configuration are exactly the planned ones: as many, the same jobs and repeats."""
    want = planned.groupBy(*keys).agg(F.count("*").alias("planned"), F.sort_array(F.collect_set(job)).alias("_jobs"), F.sort_array(F.collect_set(repeat)).alias("_repeats"))
    got = runs.where(ok).groupBy(*keys).agg(F.count("*").alias("successes"), F.sort_array(F.collect_set(job)).alias("_got"), F.sort_array(F.collect_set(repeat)).alias("_got_repeats"))
    both = want.join(got, list(keys), "left")
    complete = (F.col("successes") == F.col("planned")) & (F.col("_jobs") == F.col("_got")) & (F.col("_repeats") == F.col("_got_repeats"))
    return both.select(*keys, "planned", S.zero("successes").alias("successes"), F.coalesce(complete, F.lit(False)).alias("complete"))


def failures(rows: DataFrame, job: str, allocated: str, reserved: str, requested: str, free: str) -> DataFrame:
    """Peak allocator state over ranks, and the failed request that lacked most."""
    lack = F.col(requested) - F.coalesce(F.col(free), F.lit(0))
    return rows.groupBy(job).agg(
        F.max(allocated).alias("max_allocated"), F.max(reserved).alias("max_reserved"),
        F.max_by(requested, F.when(F.col(requested).isNotNull(), lack)).alias("requested"), F.max(lack).alias("lacking"),
    )


#: Limiter flags of a telemetry sample, and the columns of its measures: fixed values.
LIMITERS = ("sw_thermal", "hw_thermal", "sw_power")
MEASURES = ("memory", "utilization", "power", "clock", "temperature", "fan")


def telemetry(rows: DataFrame, job: Sequence[str], *, healthy_clock: float | None = None, spec_clock: float | None = None, power_limit: float | None = None, busy_from: float = 90.0, at_limit: float = 0.98) -> DataFrame:
    """Accelerator telemetry of a job (columns of MEASURES, LIMITERS as 1, 0 or null, `gpu_index` and `ts`): means, busy-time percentiles and fractions, and what held the clock back.

    An observed limiter decides; without one a clock that is low while power is at its limit, then a low clock alone;
    a clock's ceiling by specification is never a reference.
    """
    busy = F.coalesce(F.col("utilization"), F.lit(0.0)) >= busy_from
    on = {m: F.when(busy, F.col(m)) for m in MEASURES}
    flag = {f: F.when(busy, F.col(f)) for f in LIMITERS}
    share = lambda test, of: F.avg(F.when(of.isNotNull(), test.cast("int"))) if test is not None else F.lit(None).cast("double")
    out = rows.groupBy(*job).agg(
        F.max("memory").alias("peak_memory"), F.avg("utilization").alias("mean_utilization"), F.avg("power").alias("mean_power"), F.avg("clock").alias("mean_clock"),
        F.count("*").alias("samples"), F.count_if(busy).alias("busy_samples"), F.count(on["clock"]).alias("busy_clocks"),
        *(S.percentile(on["clock"], q / 100).alias(f"busy_clock_p{q}") for q in (5, 50, 95)), *(S.percentile(on["power"], q / 100).alias(f"busy_power_p{q}") for q in (50, 95)),
        S.percentile(on["temperature"], 0.95).alias("busy_temperature_p95"), F.max("temperature").alias("peak_temperature"), F.max("fan").alias("peak_fan"),
        share(on["clock"] < healthy_clock * 0.95 if healthy_clock else None, on["clock"]).alias("below_95"), share(on["clock"] < healthy_clock * 0.9 if healthy_clock else None, on["clock"]).alias("below_90"),
        share(on["power"] >= power_limit * at_limit if power_limit else None, on["power"]).alias("at_power_limit"),
        *(F.avg(c).alias(f"{f}_fraction") for f, c in flag.items()), *((F.count(c) > 0).alias(f"{f}_known") for f, c in flag.items()),
    )
    known = [F.col(f"{f}_known") for f in LIMITERS]
    seen = lambda *names: functools.reduce(operator.or_, [F.coalesce(F.col(f"{f}_fraction"), F.lit(0.0)) > 0 for f in names])
    ratio = (lambda clock: F.col("busy_clock_p50") / F.lit(clock) if clock else F.lit(None).cast("double"))
    enough = (F.col("busy_clocks") >= 3) & F.lit(healthy_clock is not None)
    inferred = F.coalesce((F.col("at_power_limit") >= 0.2) & (F.col("below_95") >= 0.2), F.lit(False))
    low = F.coalesce(F.col("clock_ratio") < 0.95, F.lit(False)) | F.coalesce(F.col("below_90") >= 0.1, F.lit(False))
    of = lambda status, source: F.struct(F.lit(status).alias("s"), F.lit(source).alias("f"))
    status = (
        F.when(seen("sw_thermal", "hw_thermal"), of("thermal_limited", "observed_throttle_reason")).when(seen("sw_power"), of("power_limited", "observed_throttle_reason"))
        .when(enough & inferred, of("power_limited", "inferred_power_cap")).when(enough & low, of("downclocked", "clock_only")).when(F.col("limiters_complete"), of("normal", "no_observed_queried_limiter"))
        .when(F.col("limiters_known"), of("insufficient_data", "partial_throttle_reason_support")).otherwise(of("insufficient_data", "missing_throttle_reason"))
    )
    out = out.withColumns({"clock_ratio": ratio(healthy_clock), "spec_clock_ratio": ratio(spec_clock), "limiters_known": functools.reduce(operator.or_, known), "limiters_complete": functools.reduce(operator.and_, known)})
    out = out.withColumns({"healthy_clock": F.lit(healthy_clock).cast("double"), "spec_clock": F.lit(spec_clock).cast("double"), "power_limit": F.lit(power_limit).cast("double"), "busy_from": F.lit(busy_from), "_status": status})
    out = out.select("*", F.col("_status.s").alias("clock_status"), F.col("_status.f").alias("clock_status_source")).drop("_status")
    return out.withColumn("downclocked", F.col("clock_status").isin("power_limited", "thermal_limited", "downclocked"))


def energy(rows: DataFrame, gpu: Sequence[str], time: Column, power: str, max_gap: float = 10.0) -> DataFrame:
    """Watt hours by the trapezoid rule, steps clamped to 0 and `max_gap` seconds, left out where either power is null.

    `time` is in seconds. Power counts in hundredths of a watt and time in microseconds, as whole numbers, so that the sum is exact in any order.
    """
    w = Window.partitionBy(*gpu).orderBy("_t")
    gap = F.least(F.lit(int(max_gap * 1_000_000)).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("_t") - F.lag("_t").over(w)))
    piece = (F.col("_p") + F.lag("_p").over(w)) * gap
    whole = rows.withColumns({"_t": F.round(time * 1_000_000).cast("long"), "_p": F.round(F.col(power) * 100).cast("long")})
    sums = whole.withColumn("_wh", piece).groupBy(*gpu).agg(S.zero(F.sum("_wh")).alias("_wh"))
    return sums.select(*gpu, (F.col("_wh") / F.lit(2.0 * 100 * 1_000_000 * 3600)).alias("energy_wh"))


def marginals(rows: DataFrame, sets: Sequence[Sequence[str]], **aggregates: Column) -> DataFrame:
    """Several groupings at once, in one pass (grouping sets)."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, names)).agg(F.grouping_id().alias("level"), *(c.alias(n) for n, c in aggregates.items()))


def flag_coverage(rows: DataFrame, gpu: str, flag: str) -> DataFrame:
    """How often a flag is known and set, by GPU and over all (gpu null)."""
    return rows.rollup(gpu).agg(F.count("*").alias("n"), F.count(flag).alias("known"), S.zero(F.sum(flag)).alias("active")).select(
        gpu, "n", "known", "active", S.rate("known", "n").alias("coverage"), S.rate("active", "known").alias("active_fraction")
    )


def length_profile(rows: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """Count, total, mean, percentiles and population deviation of lengths."""
    return rows.groupBy(*keys).agg(
        F.count(length).alias("n"), F.sum(length).alias("total"), F.avg(length).alias("mean"), F.min(length).alias("least"), F.max(length).alias("most"),
        F.stddev_pop(length).alias("deviation"), *(S.percentile(length, q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)),
    )


def cutoff_grid(rows: DataFrame, keys: Sequence[str], length: str, cutoffs: Sequence[int]) -> DataFrame:
    """For each cutoff: share of rows cut, share of tokens kept and mean length after the cut. One pass, no join."""
    grid = rows.select(*keys, F.col(length).alias("_l"), F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff"))
    kept = F.least("_l", "cutoff")
    return grid.groupBy(*keys, "cutoff").agg(
        F.avg((F.col("_l") > F.col("cutoff")).cast("int")).alias("truncation_rate"), S.rate(F.sum(kept), F.sum("_l")).alias("retained"), F.avg(kept).alias("mean_after")
    )


def replicate_fold(rows: DataFrame, keys: Sequence[str], values: Sequence[str], flag: Column, ident: str) -> DataFrame:
    """Replicates of a candidate: medians, their number, whether the flag holds for all, sorted ids."""
    return rows.groupBy(*keys).agg(*(S.median(v).alias(v) for v in values), F.count("*").alias("replicates"), S.all_true(flag).alias("all_flagged"), F.array_join(F.sort_array(F.collect_list(F.col(ident).cast("string"))), ",").alias("ids"))


def macro_micro(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of group means and plain mean."""
    per = rows.groupBy(group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return per.agg(F.avg("m").alias("macro"), S.rate(F.sum("s"), F.sum("n")).alias("micro"), F.count("*").alias("groups"))


def fallback_levels(rows: DataFrame, selector: str, coarse: Sequence[str], value: str, least: int) -> DataFrame:
    """For each selector its median, or that of its coarse group, or the pooled one: the first level with `least` rows.

    Coarse groups and the pool of all rows are as large as the table, so their medians are found in the sorted rows.
    """
    fine = rows.groupBy(selector, *coarse).agg(F.count(value).alias("n0"), S.median(value).alias("v0"))
    level = lambda keys, k: percentiles(rows, keys, value, {f"v{k}": 0.5}).withColumnRenamed("_count", f"n{k}")
    out = fine.join(level(coarse, 1), list(coarse), "left").join(F.broadcast(level([], 2)), F.lit(True), "left")  # one row
    return out.select(
        selector, *coarse, F.when(F.col("n0") >= least, 0).when(F.col("n1") >= least, 1).otherwise(2).alias("level"),
        F.when(F.col("n0") >= least, F.col("v0")).when(F.col("n1") >= least, F.col("v1")).otherwise(F.col("v2")).alias("value"),
    )


def step_utilisation(rows: DataFrame, job: str, step: str, rank: str, seconds: str, flops: str, after: int, peak: float) -> DataFrame:
    """Work by slowest-rank time over the steps after warm-up, and the mean gap between slowest and fastest rank."""
    per = rows.groupBy(job, step).agg(F.sum(flops).alias("f"), F.max(seconds).alias("slow"), F.min(seconds).alias("fast"), F.count_distinct(rank).alias("ranks"))
    return per.where(F.col(step) > after).groupBy(job).agg(
        S.rate(F.sum("f"), F.sum("slow") * F.max("ranks") * F.lit(peak)).alias("mfu"), F.avg(S.rate(F.col("slow") - F.col("fast"), "slow")).alias("straggler_gap"), F.count("*").alias("steps")
    )


def token_ledger(rows: DataFrame, job: str, order: Sequence[str], tokens: str, warmup: int, measured: int) -> DataFrame:
    """Ordered micro-batches split by position into warm-up, measured and prefetched, each summed."""
    at = F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1
    bucket = F.when(at < warmup, "warmup").when(at < warmup + measured, "measured").otherwise("prefetched")
    return rows.withColumn("bucket", bucket).groupBy(job, "bucket").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("batches"))


def run_comparison(rows: DataFrame, config: str, value: str, baseline, check: str) -> DataFrame:
    """Variation, spread and difference from a baseline configuration; whether `check` is the same throughout."""
    per = rows.groupBy(config).agg(F.avg(value).alias("mean"), S.variation(value).alias("cv"), S.rate(F.max(value) - F.min(value), F.avg(value)).alias("spread"), (F.count_distinct(check) == 1).alias("consistent"))
    base = per.where(F.col(config) == F.lit(baseline)).select(F.col("mean").alias("_base"))
    return per.join(F.broadcast(base)).select(config, "mean", "cv", "spread", "consistent", S.rate(F.col("mean") - F.col("_base"), "_base").alias("delta"))  # one row


def repeat_noise(rows: DataFrame, unit: Sequence[str], state: str, value: str) -> DataFrame:
    """max / min - 1 of each unit with two values or more, then its distribution by state."""
    per = rows.groupBy(*unit, state).agg(F.count(value).alias("n"), (F.max(value) / F.min(value) - 1).alias("noise")).where("n >= 2")
    return per.groupBy(state).agg(F.count("*").alias("units"), S.median("noise").alias("median"), S.percentile("noise", 0.9).alias("p90"), F.max("noise").alias("most"))


def crosstab(rows: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return rows.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def endpoint_summary(rows: DataFrame, keys: Sequence[str], value: str, least: int, max_spread: float) -> DataFrame:
    """Median, extremes and relative spread of repeats; whether they can be used, and why not."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), S.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))
    spread = S.rate(F.col("most") - F.col("least"), "least")
    reason = F.when(F.col("n") < least, "too_few").when(spread > max_spread, "too_noisy").otherwise("usable")
    return out.select("*", spread.alias("spread"), reason.alias("reason"))


def identifiable(rows: DataFrame, scenario: str, stage: str, mbs: str) -> DataFrame:
    """Scenarios with two stages or more, and two batch sizes or more within each."""
    per = rows.groupBy(scenario, stage).agg(F.count_distinct(mbs).alias("sizes"))
    return per.groupBy(scenario).agg(F.count("*").alias("stages"), F.min("sizes").alias("least_sizes")).withColumn("identifiable", (F.col("stages") >= 2) & (F.col("least_sizes") >= 2))


def safe_region(rows: DataFrame, scenario: Sequence[str], size: str, failed: Column) -> DataFrame:
    """Largest safe and smallest unsafe size (a size is unsafe if it ever failed), and whether they are out of order."""
    cell = rows.groupBy(*scenario, size).agg(F.bool_or(failed).alias("bad"))
    out = cell.groupBy(*scenario).agg(F.max(F.when(~F.col("bad"), F.col(size))).alias("max_safe"), F.min(F.when(F.col("bad"), F.col(size))).alias("min_unsafe"))
    return out.withColumn("violation", F.coalesce(F.col("min_unsafe") < F.col("max_safe"), F.lit(False)))


def acceptance(rows: DataFrame, scenario: str, covered: Column, false_safe: Column, least: float) -> DataFrame:
    """Coverage over all and by scenario (its 5th percentile), false safes, and whether all passes."""
    per = rows.groupBy(scenario).agg(F.avg(covered.cast("int")).alias("c"), F.sum(covered.cast("int")).alias("k"), F.count("*").alias("n"), F.count_if(false_safe).alias("f"))
    out = per.agg(S.rate(F.sum("k"), F.sum("n")).alias("coverage"), S.percentile("c", 0.05).alias("scenario_p05"), F.sum("f").alias("false_safe"), F.count("*").alias("scenarios"))
    return out.withColumn("passed", (F.col("coverage") >= least) & (F.col("false_safe") == 0))


def order_guard(rows: DataFrame, selector: Sequence[str], value: str, q: float, least: int, most: float) -> DataFrame:
    """A percentile for each selector; none where rows are too few or the value is implausible."""
    out = rows.groupBy(*selector).agg(F.count(value).alias("n"), S.percentile(value, q).alias("_v"))
    reason = F.when(F.col("n") < least, "too_few").when(F.col("_v") > most, "implausible").otherwise("ok")
    return out.select(*selector, "n", reason.alias("reason"), F.when(reason == "ok", F.col("_v")).alias("guard"))


def unique_structure(rows: DataFrame, model: str, tensor: Sequence[str], size: str) -> DataFrame:
    """Parameters and tensors of each model, a shared tensor counted once."""
    return rows.dropDuplicates([model, *tensor]).groupBy(model).agg(F.count("*").alias("tensors"), F.sum(size).alias("parameters"))
