"""Ranking and ordered analytics. Every order ends in a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.functions import stats as S
from gantry.operators.ordered import ordered_pairs


def rank_within(rows: DataFrame, groups: dict[str, Sequence[str]], order: Sequence[Column]) -> DataFrame:
    """Ranks 1..n in one order within several groupings: column name -> grouping columns."""
    return rows.withColumns({name: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) for name, keys in groups.items()})


def best_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def shortlist(rows: DataFrame, scenario: Sequence[str], resource: str, order: Sequence[Column], k: int) -> DataFrame:
    """A diverse best k: the winner of the smallest resource, the overall best, other resources' winners, then by order."""
    s = Window.partitionBy(*scenario)
    overall = F.row_number().over(s.orderBy(*order))
    within = F.row_number().over(Window.partitionBy(*scenario, resource).orderBy(*order))
    rows = rows.withColumns({"_o": overall, "_w": within, "_least": F.min(resource).over(s)})
    tier = F.when((F.col("_w") == 1) & (F.col(resource) == F.col("_least")), 0).when(F.col("_o") == 1, 1).when(F.col("_w") == 1, 2).otherwise(3)
    rows = rows.withColumn("tier", tier).withColumn("place", F.row_number().over(s.orderBy("tier", "_o")))
    return rows.where(F.col("place") <= k).drop("_o", "_w", "_least")


def bounded_shortlist(rows: DataFrame, scenario: Sequence[str], cards: str, strategy: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Before anything is measured: the best of each card count, then the best of each strategy (cards included) that these leave out, then by order; never fewer than card counts."""
    s = Window.partitionBy(*scenario)
    w = rows.withColumns({
        "_card": F.row_number().over(Window.partitionBy(*scenario, cards).orderBy(*order)), "_own": F.row_number().over(Window.partitionBy(*scenario, *strategy).orderBy(*order)),
        "_counts": F.size(F.collect_set(cards).over(s)), "_o": F.row_number().over(s.orderBy(*order)),
    })
    taken = F.max(F.when(F.col("_card") == 1, 1).otherwise(0)).over(Window.partitionBy(*scenario, *strategy)) == 1
    w = w.withColumn("_taken", taken)
    tier = F.when(F.col("_card") == 1, 0).when((F.col("_own") == 1) & ~F.col("_taken"), 1).otherwise(2)
    w = w.withColumn("tier", tier)
    w = w.withColumn("place", F.row_number().over(s.orderBy("tier", F.when(F.col("tier") == 0, F.col(cards)).otherwise(0), "_o")))
    return w.where(F.col("place") <= F.greatest(F.lit(limit), F.col("_counts"))).drop("_card", "_own", "_counts", "_o", "_taken")


def scaling(points: DataFrame, scenario: Sequence[str], cards: str, value: str, least_gain: float = 0.7) -> DataFrame:
    """Gain from the previous card count, speed-up over the first, efficiency, and whether the gain is enough."""
    w = Window.partitionBy(*scenario).orderBy(cards)
    base = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    previous = F.lag(value).over(w)
    gain = S.rate(F.col(value) - previous, previous)
    speedup = S.rate(value, base)
    return points.select("*", gain.alias("gain"), speedup.alias("speedup"), S.rate(speedup, cards).alias("efficiency"), (gain.isNull() | (gain >= least_gain)).alias("passes"))


def early_stop(points: DataFrame, scenario: Sequence[str], cards: str, value: str, least_ratio: float) -> DataFrame:
    """Decision at each card count: after the first doubling that fails, later points are skipped; points without a value wait."""
    w = Window.partitionBy(*scenario).orderBy(cards)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ratio = S.rate(value, F.last(value, ignorenulls=True).over(before))
    rows = points.withColumn("ratio", ratio).withColumn("_failed", F.coalesce(F.col("ratio") < least_ratio, F.lit(False)).cast("int"))
    stopped = F.coalesce(F.max("_failed").over(before), F.lit(0)) == 1
    decision = F.when(stopped, "skipped_by_early_stop").when(F.col(value).isNull(), "pending").when(F.col("_failed") == 1, "fail").otherwise("pass")
    return rows.withColumn("decision", decision).drop("_failed")


def default_walk(points: DataFrame, scenario: Sequence[str], cards: str, value: str, least_gain: float = 0.7) -> DataFrame:
    """From the smallest card count on, move the default to the next one while it gains enough over the current default."""
    path = F.array_sort(F.collect_list(F.struct(F.col(cards).cast("int").alias("c"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(0).alias("c"), F.lit(0.0).alias("v"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        moves = (acc["c"] == 0) | (~acc["done"] & ((x["v"] - acc["v"]) / acc["v"] >= least_gain))
        taken = F.struct(x["c"].alias("c"), x["v"].alias("v"), F.lit(False).alias("done"))
        return F.when(moves, taken).otherwise(F.struct(acc["c"].alias("c"), acc["v"].alias("v"), F.lit(True).alias("done")))

    out = points.groupBy(*scenario).agg(F.aggregate(path, start, step).alias("d"))
    return out.select(*scenario, F.col("d.c").alias("default_cards"), F.col("d.v").alias("default_value"))


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    ranked = rows.withColumn("_x", average_rank(x, keys)).withColumn("_y", average_rank(y, keys))
    return ranked.groupBy(*keys).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def spearman_ordinal(rows: DataFrame, keys: Sequence[str], x: str, y: str, ident: str) -> DataFrame:
    """Ties are broken by the id instead of averaged."""
    place = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, ident))
    return rows.withColumn("_x", place(x)).withColumn("_y", place(y)).groupBy(*keys).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def pairwise_accuracy(rows: DataFrame, keys: Sequence[str], predicted: str, observed: str) -> DataFrame:
    """Share of pairs within a group in the observed order; observed ties are left out, a predicted tie is a miss. Groups may be of any size."""
    return ordered_pairs(rows, keys, predicted, observed).where("pairs > 0").withColumn("accuracy", S.rate("correct", "pairs"))


def top_regret(rows: DataFrame, keys: Sequence[str], predicted: str, observed: str, ident: str, tolerance: float = 0.1) -> DataFrame:
    """What the best predicted candidate loses against the best observed one, and whether that is within the tolerance."""
    out = rows.groupBy(*keys).agg(F.max_by(observed, F.struct(F.col(predicted), -F.col(ident))).alias("_sel"), F.max(observed).alias("_best"))
    regret = F.greatest(F.lit(0.0), 1 - S.rate("_sel", "_best"))
    return out.select(*keys, regret.alias("regret"), (regret <= tolerance).alias("hit"))


def counter_delta(rows: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("delta", F.col(counter) - F.coalesce(F.lag(counter).over(w), F.lit(0)))


def expected_batch_max(rows: DataFrame, keys: Sequence[str], length: str, ident: str, sizes: Sequence[int]) -> DataFrame:
    """Expected longest of a random batch, from the empirical distribution, in closed form."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(length, ident)), F.count("*").over(w)
    placed = rows.select(*keys, length, (i / n).alias("_hi"), ((i - 1) / n).alias("_lo")).withColumn("batch", F.explode(F.array(*map(F.lit, sizes))))
    return placed.groupBy(*keys, "batch").agg(F.sum(F.col(length) * (F.pow("_hi", "batch") - F.pow("_lo", "batch"))).alias("expected"))


def balanced_folds(groups: DataFrame, group: str, weight: str, folds: int) -> DataFrame:
    """Largest group to the least loaded fold, ties to the lower index; the groups' counts are the only state."""
    path = F.array_sort(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(group).alias("g"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), folds).alias("load"), F.array().cast("array<int>").alias("at"))

    def place(acc: Column, x: Column) -> Column:
        k = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i + 1 == k, v - x["w"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["at"], F.array(k - 1)).alias("at"))

    out = groups.agg(path.alias("p")).select("p", F.aggregate("p", start, place).alias("r"))
    return out.select(F.explode(F.arrays_zip(F.col("p.g").alias("g"), F.col("r.at").alias("at"))).alias("x")).select(F.col("x.g").alias(group), F.col("x.at").alias("fold"))


def stride_downsample(rows: DataFrame, series: str, order: Sequence[str], budget: int) -> DataFrame:
    """Every so many points of each series to stay within a total budget, the last always; unchanged if all fit."""
    s = Window.partitionBy(series)
    counted = rows.withColumns({"_i": F.row_number().over(s.orderBy(*order)), "_n": F.count("*").over(s)})
    totals = rows.agg(F.count("*").alias("_all"), F.count_distinct(series).alias("_series"))
    stride = F.ceil(F.col("_n") / F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_series"))))
    keep = (F.col("_all") <= budget) | ((F.col("_i") - 1) % stride == 0) | (F.col("_i") == F.col("_n"))
    return counted.join(F.broadcast(totals)).where(keep).drop("_i", "_n", "_all", "_series")  # one row
