"""Candidate grids, job materialisation, packing of lengths and wave plans."""

from __future__ import annotations

import bisect
import collections
import random
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.functions import numeric as N
from gantry.operators.ordered import positions

#: Micro-batch sizes by cut-off: fixed values.
LADDER = ((512, (1, 2, 4, 8, 16, 32)), (2048, (1, 2, 4, 8, 16)), (4096, (1, 2, 4, 8)), (8192, (1, 2, 4)))
LONGEST_LADDER = (1, 2)


def ladder(cutoff: Column) -> Column:
    out = None
    for most, sizes in LADDER:
        value = F.array(*map(F.lit, sizes))
        out = F.when(cutoff <= most, value) if out is None else out.when(cutoff <= most, value)
    return out.otherwise(F.array(*map(F.lit, LONGEST_LADDER)))


def candidates(requests: DataFrame, capacity: int, share: float = 0.95, cards: Sequence[int] = (1, 2, 4), stage_one: bool = False, checkpointing: Sequence[bool] = (True, False), adapter_share: float = 0.01) -> DataFrame:
    """All configurations of requests (mode, batch, cutoff, parameters), each with the reason it can't be, or null.

    Only arithmetic speaks against a candidate: a batch that doesn't divide, or state alone beyond the capacity.
    """
    many = F.array(*map(F.lit, (1, 2, 3) if stage_one else (2, 3)))
    out = requests.withColumn("cards", F.explode(F.array(*map(F.lit, cards))))
    out = out.withColumn("stage", F.explode(F.when(F.col("cards") == 1, F.array(F.lit(0))).otherwise(many)))
    out = out.withColumn("mbs", F.explode(ladder(F.col("cutoff")))).withColumn("gc", F.explode(F.array(*map(F.lit, checkpointing))))
    trainable = F.when(F.col("mode") == "full", F.col("parameters")).otherwise(F.greatest(F.lit(1).cast("long"), (F.col("parameters") * adapter_share).cast("long")))
    floor = N.state_floor(F.col("parameters"), trainable, F.col("cards"), F.col("stage"))
    steps = N.exact_accumulation(F.col("batch"), F.col("cards"), F.col("mbs"))
    reason = F.when(steps.isNull(), "batch_not_divisible").when(floor > F.lit(int(capacity * share)), "state_exceeds_capacity")
    return out.withColumn("accumulation", steps).withColumn("floor_bytes", floor).withColumn("reason", reason)


def grid(base: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the axes' values for each row."""
    for name, values in axes.items():
        base = base.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return base


def matrix(models: DataFrame, kinds: Mapping[str, Mapping[str, Sequence]]) -> DataFrame:
    """Experiment requests of several kinds, each a grid of its own, in one table."""
    out = None
    for kind, axes in kinds.items():
        part = grid(models, axes).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def jobs_from(requests: DataFrame, boundaries: DataFrame, keys: Sequence[str], sizes: str, most: str, last: int, repeats: int) -> DataFrame:
    """The last few feasible sizes of each request, repeated."""
    rows = requests.join(boundaries, list(keys), "left")
    ok = F.filter(F.col(sizes), lambda m: m <= F.coalesce(F.col(most), F.lit(1)))
    top = F.when(F.size(ok) > 0, F.slice(ok, F.greatest(F.lit(1), F.size(ok) - last + 1), last)).otherwise(ok)
    out = rows.withColumn("mbs", F.explode(top))
    return out.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))


def greedy_packs(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Packs filled with the largest item that still fits; an item over the capacity is an error."""
    left, packs = sorted(lengths), []
    if left and left[-1] > capacity:
        raise ValueError("a length exceeds the capacity")
    while left:
        room, pack = capacity, []
        while (at := bisect.bisect_right(left, room)) > 0:
            pack.append(left.pop(at - 1))
            room -= pack[-1]
        packs.append(pack)
    return packs


def knapsack(rows: DataFrame, group: str, position: str, length: str, capacity: int, workers: int, total: DataFrame | None = None) -> DataFrame:
    """Greedy packs of each contiguous worker shard of each group: group, shard, packs, items, used.

    Shard of position p (from 0) of n is ((p + 1) * w - 1) // n with w the lesser of workers and n; one shard is the
    unit that a task holds.
    """
    n = F.count("*").over(Window.partitionBy(group))
    w = F.least(F.lit(workers).cast("long"), n)
    shard = F.floor(((F.col(position) + 1) * w - 1) / n).cast("long")
    dealt = rows.select(F.col(group).alias("group"), shard.alias("shard"), F.least(F.col(length), F.lit(capacity)).cast("long").alias("length"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        packs = greedy_packs(pdf["length"].tolist(), capacity)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "packs": [len(packs)], "items": [len(pdf)], "used": [int(pdf["length"].sum())]})

    return dealt.groupBy("group", "shard").applyInPandas(pack, f"group {dict(rows.dtypes)[group]}, shard long, packs long, items long, used long")


def best_fit_bins(lengths: Sequence[int], capacity: int) -> list[int]:
    """Room left in the bins of best fit in descending order."""
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - x)
    return rooms


def best_fit(rows: DataFrame, group: str, length: str, cutoffs: Sequence[int]) -> DataFrame:
    """Bins and utilisation of best fit decreasing for each group and cut-off (lengths cut)."""
    cells = rows.select(F.col(group).alias("group"), F.col(length).alias("length"), F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cutoff = int(pdf["cutoff"].iloc[0])
        cut = pdf["length"].clip(upper=cutoff).astype(int).tolist()
        rooms = best_fit_bins(cut, cutoff)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "cutoff": [cutoff], "bins": [len(rooms)], "utilisation": [sum(cut) / (cutoff * len(rooms)) if rooms else None]})

    return cells.groupBy("group", "cutoff").applyInPandas(pack, f"group {dict(rows.dtypes)[group]}, cutoff int, bins long, utilisation double")


def padding(rows: DataFrame, group: str, order: Sequence[str], length: str, size: int) -> DataFrame:
    """Share of real tokens when batches of a fixed order are padded to their longest."""
    w = Window.partitionBy(group).orderBy(*order)
    batch = F.floor((F.row_number().over(w) - 1) / size)
    per = rows.select(group, F.col(length).alias("_l"), batch.alias("_b")).groupBy(group, "_b").agg(F.sum("_l").alias("s"), (F.max("_l") * F.count("*")).alias("p"))
    return per.groupBy(group).agg(F.sum("s").alias("real"), F.sum("p").alias("padded")).withColumn("utilisation", F.col("real") / F.col("padded"))


def shuffled_padding(rows: DataFrame, group: str, order: str, length: str, size: int, seeds: Sequence[int]) -> DataFrame:
    """The same over seeded shuffles, averaged."""

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf.sort_values(order)[length].tolist()
        real = padded = 0
        for seed in seeds:
            mixed = list(lengths)
            random.Random(seed).shuffle(mixed)
            parts = [mixed[i : i + size] for i in range(0, len(mixed), size)]
            real += sum(mixed)
            padded += sum(max(p) * len(p) for p in parts)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "utilisation": [real / padded]})

    return rows.select(group, order, length).groupBy(group).applyInPandas(measure, f"{group} {dict(rows.dtypes)[group]}, utilisation double")


def homogeneous_waves(jobs: DataFrame, job: str, cards: str, total: int) -> DataFrame:
    """Jobs of one size together, as many at once as cards allow."""
    at = F.row_number().over(Window.partitionBy(cards).orderBy(job)) - 1
    fit = F.floor(F.lit(total) / F.col(cards)).cast("long")
    return jobs.withColumn("wave", F.floor(at / fit).cast("long")).withColumn("place", (at % fit).cast("long")).withColumn("full", F.col(cards) * fit == total)


def _subset(sizes: Sequence[int], total: int) -> tuple[list[int], bool]:
    """Positions whose sizes, in this order, first sum to the total, or to the most that is reached; whether it is the total."""
    best: dict[int, list[int]] = {0: []}
    for i, n in enumerate(sizes):
        for s in sorted(best, reverse=True):
            if s + n <= total and s + n not in best:
                best[s + n] = [*best[s], i]
        if total in best:
            break
    return best[max(best)], total in best


def mixed_runs(counts: Mapping[int, int], total: int, tail: str = "error") -> list[tuple[int, int, dict[int, int], dict[int, int]]]:
    """Waves of so many jobs of each size as runs of waves alike: first wave, number of waves, jobs a wave takes of each size and jobs that run again.

    Jobs of one size are taken in their order, and no wave sees more of a size than fit the total, so the same wave goes on
    until a size has fewer left: the number of runs depends on sizes and total, not on jobs.
    """
    left, runs, wave = {n: counts[n] for n in sorted(counts, reverse=True) if counts[n]}, [], 0
    most = {n: max(1, total // n) if n > 0 else 1 for n in left}
    while left:
        sizes = [n for n, c in left.items() for _ in range(min(c, most[n]))]
        pick, whole = _subset(sizes, total)
        again: dict[int, int] = {}
        if not whole and tail == "error":
            raise ValueError(f"{dict(left)} (size: jobs) fill no whole wave of {total}")
        if not whole and tail != "partial":  # repeat: jobs that ran fill up
            room, pick = total - sizes[0], [0]
            for n in sorted(counts, reverse=True):
                again[n] = min(counts[n], max(0, room // n)) if n > 0 else counts[n] if room >= 0 else 0
                room -= again[n] * n
        taken = collections.Counter(sizes[i] for i in pick or [0])
        # as long as each size that is taken stays above what a wave sees of it
        times = min((left[n] - most[n]) // k + 1 if left[n] >= most[n] else 1 for n, k in taken.items())
        runs.append((wave, times, dict(taken), {n: k for n, k in again.items() if k}))
        wave += times
        left = {n: c - times * taken[n] for n, c in left.items() if c > times * taken[n]}
    return runs


def mixed_waves(sizes: Sequence[tuple[str, int]], total: int, tail: str = "error") -> list[list[str]]:
    """Waves that use all cards, each a subset whose sizes sum to the total, larger jobs first; the tail by policy."""
    queues: dict[int, list[str]] = {}
    for job, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        queues.setdefault(n, []).append(job)
    at, waves = dict.fromkeys(queues, 0), []
    for _, times, taken, again in mixed_runs({n: len(q) for n, q in queues.items()}, total, tail):
        for _ in range(times):
            waves.append([j for n, k in taken.items() for j in queues[n][at[n] : at[n] + k]] + [j for n, k in again.items() for j in queues[n][:k]])
            at |= {n: at[n] + k for n, k in taken.items()}
    return waves


def unbounded_fill(total: int, sizes: Sequence[int]) -> list[int] | None:
    """Fewest sizes, each as often as needed, that sum to the total; null if none do."""
    best: list[list[int] | None] = [[], *[None] * total]
    for s in range(1, total + 1):
        options = [[*best[s - n], n] for n in sorted(set(sizes), reverse=True) if n <= s and best[s - n] is not None]
        best[s] = min(options, key=len, default=None)
    return sorted(best[total], reverse=True) if best[total] is not None else None


def place(need: int, free: set[int], cards: Sequence[int], running: int, exclusive: bool = False) -> list[int] | None:
    """Cards for a job, or none for now: pairs stand on aligned pairs, singles on the lowest; larger or exclusive jobs want an idle machine."""
    if exclusive or need > 2:
        idle = running == 0 and (not exclusive or free == set(cards))
        return (list(cards) if exclusive else sorted(free))[:need] if idle and len(free) >= need else None
    if need == 2:
        return next((list(cards[i : i + 2]) for i in range(0, len(cards) - 1, 2) if set(cards[i : i + 2]) <= free), None)
    return [min(free)] if free else None


def _first_fit(left: Sequence[tuple], cards: Sequence[int]) -> tuple[list[tuple], list[tuple]]:
    """One wave of jobs (job, cards, whether it wants the machine alone) with their cards, and the jobs that wait."""
    free, wave, rest = set(cards), [], []
    for job, n, exclusive in left:
        mask = place(n, free, cards, len(wave), exclusive) if free else None
        if mask is None:
            rest.append((job, n, exclusive))
        else:
            free -= set(mask)
            wave.append((job, mask))
    if not wave:
        raise ValueError(f"{rest[0][0]} needs more cards than there are")
    return wave, rest


def first_fit_masks(jobs: Sequence[tuple], cards: Sequence[int], in_order: bool = False) -> list[list[tuple[str, list[int]]]]:
    """Waves of jobs (job, cards and perhaps whether it wants the machine alone) on cards; what doesn't fit waits for the next wave.

    Shared jobs come before exclusive ones and larger before smaller, unless the queue's order is to be kept.
    """
    waves, left = [], [(*j, False)[:3] for j in jobs]
    if not in_order:
        left.sort(key=lambda j: (j[2], -j[1]))
    while left:
        wave, left = _first_fit(left, cards)
        waves.append(wave)
    return waves


def first_fit_runs(counts: Mapping[int, int], cards: Sequence[int]) -> list[tuple[int, int, dict[int, list[list[int]]]]]:
    """First-fit waves of so many jobs of each size as runs of waves alike: first wave, number of waves, masks for each size in turn.

    Of jobs of one size that come one after another the first ones fit, and no wave has more of them than cards.
    """
    left, runs, wave, most = {n: counts[n] for n in sorted(counts, reverse=True) if counts[n]}, [], 0, len(cards)
    while left:
        placed, _ = _first_fit([(f"a job of {n}", n, False) for n, c in left.items() for _ in range(min(c, most))], cards)
        masks: dict[int, list[list[int]]] = {}
        for job, mask in placed:
            masks.setdefault(int(job.rsplit(" ", 1)[1]), []).append(mask)
        times = min((left[n] - most) // len(m) + 1 if left[n] >= most else 1 for n, m in masks.items())
        runs.append((wave, times, masks))
        wave += times
        left = {n: c - times * len(masks.get(n, ())) for n, c in left.items() if c > times * len(masks.get(n, ()))}
    return runs


#: What a run of waves does with jobs of a size: those from `first` on, as many a wave as there are masks; `again` gives each wave the same ones.
_RUN = "wave long, times long, first long, per long, masks array<string>, again boolean"


def _by_runs(jobs: DataFrame, group: str, job: str, cards: str, order: Column, runs: Callable[[dict[int, int]], list[tuple]]) -> DataFrame:
    """Jobs with `wave` and `mask`, from runs of waves alike that follow from the number of jobs of each size; a task sees a queue's counts alone."""
    kinds = dict(jobs.dtypes)
    rows = jobs.select(F.col(group), order.alias("_order"), F.col(job).cast("string").alias("job"), F.col(cards).cast("long").alias("_n"))
    placed = positions(rows, [group, "_n"], ["_order"], "_at")
    counts = placed.groupBy(group, "_n").agg(F.count("*").alias("_count"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        found = runs(dict(zip(pdf["_n"].astype(int).tolist(), pdf["_count"].tolist(), strict=True)))
        return pd.DataFrame([(pdf[group].iloc[0], *r) for r in found], columns=[group, "_n", "wave", "times", "first", "per", "masks", "again"])

    planned = counts.groupBy(group).applyInPandas(plan, f"{group} {kinds[group]}, _n long, {_RUN}")
    p, r = placed.alias("p"), planned.alias("r")  # a few rows for each queue and size
    number = F.col("p._at") - F.col("r.first")
    mine = F.when(F.col("r.again"), number < F.col("r.per")).otherwise(number < F.col("r.per") * F.col("r.times"))
    same = F.col(f"p.{group}").eqNullSafe(F.col(f"r.{group}")) & (F.col("p._n") == F.col("r._n")) & (number >= 0) & mine
    waves = F.when(F.col("r.again"), F.sequence(F.col("r.wave"), F.col("r.wave") + F.col("r.times") - 1)).otherwise(F.array(F.col("r.wave") + F.floor(number / F.col("r.per"))))
    mask = F.col("r.masks")[(number % F.col("r.per")).cast("int")]
    return p.join(r, same).select(F.col(f"p.{group}").alias(group), F.explode(waves).alias("wave"), F.col("p.job").alias("job"), mask.alias("mask"))


def preview_waves(jobs: DataFrame, group: str, job: str, cards: str, machine: Sequence[int]) -> DataFrame:
    """First-fit waves of each queue: group, wave, job, mask. A queue is one machine's."""

    def runs(counts: dict[int, int]) -> list[tuple]:
        at, out = dict.fromkeys(counts, 0), []
        for wave, times, masks in first_fit_runs(counts, machine):
            for n, m in masks.items():
                out.append((n, wave, times, at[n], len(m), [",".join(map(str, x)) for x in m], False))
                at[n] += times * len(m)
        return out

    return _by_runs(jobs, group, job, cards, F.col(job), runs)


def plan_waves(jobs: DataFrame, group: str, job: str, cards: str, total: int, tail: str = "partial") -> DataFrame:
    """Mixed waves of each group of jobs: group, wave, job. A group is one queue of one machine."""

    def runs(counts: dict[int, int]) -> list[tuple]:
        at, out = dict.fromkeys(counts, 0), []
        for wave, times, taken, again in mixed_runs(counts, total, tail):
            out += [(n, wave, times, 0, k, None, True) for n, k in again.items()]
            for n, k in taken.items():
                out.append((n, wave, times, at[n], k, None, False))
                at[n] += times * k
        return out

    return _by_runs(jobs, group, job, cards, F.col(job).cast("string"), runs).drop("mask")


def packing_branches(scenarios: DataFrame, decisions: DataFrame, key: str, capacity: int) -> DataFrame:
    """Candidates with and without packing for each scenario; packed ones count by the scenario's decision, else as shadow."""
    plain = candidates(scenarios, capacity).withColumn("packing", F.lit(False)).withColumn("branch", F.lit("off"))
    packed = candidates(scenarios, capacity).where("mbs = 1").withColumn("packing", F.lit(True)).join(decisions, key, "left")
    packed = packed.withColumn("branch", F.when(F.col("decision") == "on", "on").otherwise("shadow")).drop("decision")
    return plain.unionByName(packed)
