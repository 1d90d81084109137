"""Statistics and fitted models. Sums are distributed; only matrices of the features' size are solved on the driver."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.functions import stats as S

# -- order statistics ------------------------------------------------------------------------------------------------


def scenario_weights(rows: DataFrame, scenario: str) -> DataFrame:
    """Each scenario weighs the same, all rows one on average: n / (scenarios * rows of the scenario)."""
    totals = rows.agg(F.count("*").alias("_n"), F.count_distinct(scenario).alias("_s"))
    per = rows.groupBy(F.col(scenario).alias("_k")).agg(F.count("*").alias("_m"))
    out = rows.join(per, F.col(scenario) == F.col("_k")).join(F.broadcast(totals))  # one row
    return out.withColumn("weight", F.col("_n") / (F.col("_s") * F.col("_m"))).drop("_n", "_s", "_m", "_k")


def conformal(rows: DataFrame, keys: Sequence[str], value: str, coverage: str, upper: bool = True) -> DataFrame:
    """The order statistic of split conformal prediction, null where it is not identifiable.

    Coverage is a decimal as text, so that the rank is exact: ceil((n + 1) p), or floor((n + 1)(1 - p)) from below.
    """
    w = Window.partitionBy(*keys)
    p = F.lit(coverage).cast("decimal(9,6)")
    n = F.count("*").over(w)
    rank = F.ceil((n + 1) * p) if upper else F.floor((n + 1) * (F.lit(1).cast("decimal(9,6)") - p))
    placed = rows.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(value)), "n": n, "rank": rank.cast("long")})
    out = placed.groupBy(*keys).agg(F.max("n").alias("n"), F.max("rank").alias("rank"), F.max(F.when(F.col("_i") == F.col("rank"), F.col(value))).alias("bound"))
    return out.withColumn("identifiable", F.col("bound").isNotNull())


def kaplan_meier(rows: DataFrame, keys: Sequence[str], value: str, event: str, probability: float) -> DataFrame:
    """Smallest value at which the product-limit survival falls to 1 - p; events come before censorings at one value."""
    per = rows.groupBy(*keys, value).agg(F.sum(F.col(event).cast("int")).alias("d"), F.count("*").alias("m"))
    w = Window.partitionBy(*keys)
    at_risk = F.sum("m").over(w.orderBy(F.col(value).desc()))
    up = w.orderBy(value)
    per = per.withColumn("_r", at_risk)
    logs = F.sum(F.when(F.col("d") < F.col("_r"), F.log(1 - F.col("d") / F.col("_r"))).otherwise(0.0)).over(up)
    dead = F.max((F.col("d") == F.col("_r")).cast("int")).over(up) == 1
    per = per.withColumns({"_s": F.when(dead, 0.0).otherwise(F.exp(logs)), "_e": F.sum("d").over(up)})
    hit = (F.col("d") > 0) & (F.col("_s") <= 1 - probability + 1e-12)
    out = per.groupBy(*keys).agg(F.sum("m").alias("n"), F.min(F.when(hit, F.col(value))).alias("quantile"), F.min(F.when(hit, F.col("_e"))).alias("rank"))
    return out.withColumn("identifiable", F.col("quantile").isNotNull())


def isotonic(values: Sequence[float], weights: Sequence[float], low: float = -np.inf, high: float = np.inf) -> list[float]:
    """Weighted least squares under an ascending order (pool adjacent violators), then within bounds."""
    blocks: list[list[float]] = []  # sum, weight, length
    for v, w in zip(values, weights, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            s, w2, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w2, blocks[-1][2] + n]
    return [min(high, max(low, s / w)) for s, w, n in blocks for _ in range(int(n))]


def isotonic_fit(rows: DataFrame, keys: Sequence[str], order: str, value: str, weight: str, low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    """Ascending fit of each group's curve; rows of one order value are merged before, so a group is a short curve."""
    curve = rows.groupBy(*keys, order).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))
    kinds = dict(curve.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, order]) + ", fitted double"

    def run(pdf):
        pdf = pdf.sort_values(order)
        return pdf[[*keys, order]].assign(fitted=isotonic(pdf[value].tolist(), pdf[weight].tolist(), low, high))

    return curve.groupBy(*keys).applyInPandas(run, schema)


# -- linear models ---------------------------------------------------------------------------------------------------


@dataclass
class Gram:
    """Weighted sums of products of features and target: all a linear fit needs, and they add and subtract."""

    names: list[str]
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    weight: float

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.names, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.weight + other.weight)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy, self.weight - other.weight)

    def ridge(self, alpha: float = 0.0, free: Sequence[int] = (0,)) -> np.ndarray:
        """Coefficients with a penalty on all but the free ones."""
        penalty = np.full(len(self.names), alpha)
        penalty[list(free)] = 0.0
        return np.linalg.solve(self.xx + np.diag(penalty), self.xy) if np.linalg.matrix_rank(self.xx + np.diag(penalty)) == len(penalty) else np.linalg.lstsq(self.xx + np.diag(penalty), self.xy, rcond=None)[0]

    def r_squared(self, coefficients: np.ndarray) -> float:
        rest = self.yy - 2 * coefficients @ self.xy + coefficients @ self.xx @ coefficients
        total = self.yy - self.xy[0] ** 2 / self.weight
        return 1 - rest / total if total > 0 else 0.0


def gram(rows: DataFrame, features: Mapping[str, Column], target: Column, weight: Column | None = None, by: str | None = None) -> dict:
    """The sums for each value of `by` (or one, under None), in one pass; an intercept comes first."""
    x = [F.lit(1.0), *features.values()]
    w = weight if weight is not None else F.lit(1.0)
    n = len(x)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    sums = [F.sum(w * x[i] * x[j]).alias(f"xx_{i}_{j}") for i, j in cells] + [F.sum(w * x[i] * target).alias(f"xy_{i}") for i in range(n)]
    sums += [F.sum(w * target * target).alias("yy"), F.sum(w).alias("w")]
    grouped = rows.groupBy(F.col(by).alias("_by")) if by else rows.groupBy(F.lit(None).cast("string").alias("_by"))
    out = {}
    for r in grouped.agg(*sums).collect():
        xx = np.zeros((n, n))
        for i, j in cells:
            xx[i, j] = xx[j, i] = r[f"xx_{i}_{j}"]
        out[r["_by"]] = Gram(["1", *features], xx, np.array([r[f"xy_{i}"] for i in range(n)], dtype=float), r["yy"], r["w"])
    return out


def linear(features: Sequence[Column], coefficients: Sequence[float]) -> Column:
    out = F.lit(float(coefficients[0]))
    for x, b in zip(features, coefficients[1:], strict=True):
        out = out + x * F.lit(float(b))
    return out


def left_out_fits(rows: DataFrame, features: Mapping[str, Column], target: Column, fold: str, alpha: float = 0.0) -> DataFrame:
    """For each fold the coefficients fitted without it: the total sums less the fold's own."""
    per = gram(rows, features, target, by=fold)
    total = None
    for g in per.values():
        total = g if total is None else total + g
    data = [(k, *map(float, (total - g).ridge(alpha))) for k, g in per.items()]
    names = [f"b{i}" for i in range(len(features) + 1)]
    return rows.sparkSession.createDataFrame(data, f"{fold} {dict(rows.dtypes)[fold]}, " + ", ".join(f"{n} double" for n in names))


def left_out_lines(rows: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """For each fold intercept and slope (b0, b1) of a line fitted without it, from sums that subtract; nothing is solved on the driver."""
    sums = {"n": F.count("*").cast("double"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y))}
    per = rows.groupBy(fold).agg(*(c.alias(k) for k, c in sums.items()))
    total = per.agg(*(F.sum(k).alias(f"_{k}") for k in sums))
    both = per.join(F.broadcast(total))  # one row
    n, sx, sy, sxx, sxy = (F.col(f"_{k}") - F.col(k) for k in sums)
    det = n * sxx - sx * sx
    return both.select(fold, ((sxx * sy - sx * sxy) / det).alias("b0"), ((n * sxy - sx * sy) / det).alias("b1"))


def standardised(rows: DataFrame, columns: Sequence[str], weight: Column | None = None, floor: float = 1e-9) -> DataFrame:
    """Columns less their weighted mean, by their deviation (1 where that is under the floor)."""
    w = weight if weight is not None else F.lit(1.0)
    mean = rows.agg(*((F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns)).first()
    spread = rows.agg(*(F.sqrt(F.sum(w * F.pow(F.col(c) - F.lit(float(mean[c])), 2)) / F.sum(w)).alias(c) for c in columns)).first()
    return rows.withColumns({f"z_{c}": (F.col(c) - float(mean[c])) / (float(spread[c]) if spread[c] > floor else 1.0) for c in columns})


def expanded(columns: Sequence[str], gates: Sequence[str] = (), limit: float = 3.0) -> dict[str, Column]:
    """Bounded values, their squares and products with gates."""
    flat = {c: F.tanh(F.col(c) / limit) * limit for c in columns}
    return flat | {f"{c}_sq": x * x for c, x in flat.items()} | {f"{g}_{c}": F.col(g) * x for g in gates for c, x in flat.items()}


def huber_fit(rows: DataFrame, features: Mapping[str, Column], target: Column, delta: float = 1.345, rounds: int = 12, low: Sequence[float] | None = None, high: Sequence[float] | None = None, alpha: float = 1e-9) -> np.ndarray:
    """Robust fit within bounds: rows reweighted by their residual against its median deviation, solved coordinate by coordinate."""
    beta = next(iter(gram(rows, features, target).values())).ridge(alpha)
    lo = np.full(len(beta), -np.inf) if low is None else np.asarray(low, dtype=float)
    hi = np.full(len(beta), np.inf) if high is None else np.asarray(high, dtype=float)
    beta = np.clip(beta, lo, hi)
    columns = list(features.values())
    for _ in range(rounds):
        residual = target - linear(columns, beta)
        middle = rows.agg(F.percentile_approx(residual, 0.5, 10_000).alias("m")).first()["m"]  # within a ten-thousandth of the ranks
        scale = max(1.4826 * (rows.agg(F.percentile_approx(F.abs(residual - middle), 0.5, 10_000).alias("s")).first()["s"] or 0.0), 1e-12)
        z = F.abs(residual) / scale
        g = next(iter(gram(rows, features, target, F.when(z <= delta, 1.0).otherwise(F.lit(delta) / z)).values()))
        new = beta.copy()
        for _ in range(100):
            before = new.copy()
            for k in range(len(new)):
                new[k] = np.clip((g.xy[k] - g.xx[k] @ new + g.xx[k, k] * new[k]) / max(g.xx[k, k] + alpha, 1e-300), lo[k], hi[k])
            if np.abs(new - before).max() <= 1e-12 * max(1.0, np.abs(new).max()):
                break
        done = np.abs(new - beta).max() <= 1e-9 * max(1.0, np.abs(beta).max())
        beta = new
        if done:
            break
    return beta


def censored_ridge(rows: DataFrame, features: Mapping[str, Column], target: Column, censored: Column, alpha: float = 1e-6, delta: float | None = None, weight: Column | None = None, constraint: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Ridge in which a censored row counts only while the fit is below its bound (active set), with Huber weights beyond `delta`.

    It begins with the exact rows alone. A round ends when the same rows are active and the coefficients rest.
    """
    w, columns = (weight if weight is not None else F.lit(1.0)), list(features.values())
    beta = next(iter(gram(rows.where(~censored), features, target, w).values())).ridge(alpha)
    active = -1
    for _ in range(rounds):
        residual = linear(columns, beta) - target
        binding = censored & (residual < 0)
        robust = F.lit(1.0) if delta is None else F.least(F.lit(1.0), F.lit(delta) / F.greatest(F.abs(residual), F.lit(1e-12)))
        share = w * robust * F.when(censored, constraint).otherwise(1.0)
        g = next(iter(gram(rows, features, target, F.when(~censored | binding, share).otherwise(0.0)).values()))
        now = rows.agg(F.sum(F.when(binding, F.xxhash64(*columns, target) % 1_000_003).otherwise(0)).alias("s")).first()["s"]
        new = g.ridge(alpha)
        done = now == active and np.abs(new - beta).max() < 1e-9
        beta, active = new, now
        if done:
            break
    return beta


def logistic_ridge(rows: DataFrame, features: Mapping[str, Column], label: Column, weight: Column | None = None, alpha: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton steps on distributed sums: each round solves a weighted least squares of the features' size."""
    beta, columns = np.zeros(len(features) + 1), list(features.values())
    w = weight if weight is not None else F.lit(1.0)
    y = label.cast("double")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-linear(columns, beta)))
        g = next(iter(gram(rows, features, (y - p) / F.greatest(p * (1 - p), F.lit(1e-12)), w * F.greatest(p * (1 - p), F.lit(1e-12))).values()))
        penalty = np.full(len(beta), alpha)
        penalty[0] = 0.0
        step = np.linalg.solve(g.xx + np.diag(penalty + 1e-12), g.xy - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta


def balanced(rows: DataFrame, source: str, label: Column) -> DataFrame:
    """`rows` with `weight`: rows of a source share its weight, then both classes get half of the whole each."""
    by_source = rows.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    marked = rows.withColumn("_label", label.cast("int")).join(by_source, F.col(source).eqNullSafe(F.col("_source")))
    by_class = marked.groupBy(F.col("_label").alias("_class")).agg(F.sum(1.0 / F.col("_n")).alias("_total"))
    out = marked.join(F.broadcast(by_class), F.col("_label") == F.col("_class"))  # a row a class
    return out.withColumn("weight", 0.5 / F.col("_n") / F.col("_total")).drop("_source", "_n", "_label", "_class", "_total")


def pair_gram(rows: DataFrame, scenario: str, ident: str, features: Sequence[str], target: str) -> Gram:
    """Sums of products over the differences of all pairs within a scenario, the later id less the earlier, from sums over rows.

    The products of differences add up to n times the products less the product of the sums; the differences
    themselves to each value times the pairs it is the later of less those it is the earlier of.
    """
    w = Window.partitionBy(scenario).orderBy(ident)
    columns = [*features, target]
    placed = rows.select(scenario, *(F.col(c).cast("double").alias(c) for c in columns), F.row_number().over(w).alias("_r"))
    per = placed.groupBy(scenario).agg(
        F.count("*").cast("double").alias("n"), *(F.sum(c).alias(f"s_{i}") for i, c in enumerate(columns)), *(F.sum(F.col(c) * F.col("_r")).alias(f"r_{i}") for i, c in enumerate(columns)),
        *(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p_{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))),
    )
    n = F.col("n")
    one = per.agg(
        F.sum(n * (n - 1) / 2).alias("w"), *(F.sum(2 * F.col(f"r_{i}") - (n + 1) * F.col(f"s_{i}")).alias(f"d_{i}") for i in range(len(columns))),
        *(F.sum(n * F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"x_{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))),
    ).first()
    k = len(features)
    xx = np.zeros((k + 1, k + 1))
    xx[0, 0] = one["w"]
    for i in range(k):
        xx[0, i + 1] = xx[i + 1, 0] = one[f"d_{i}"]
        for j in range(i, k):
            xx[i + 1, j + 1] = xx[j + 1, i + 1] = one[f"x_{i}_{j}"]
    xy = np.array([one[f"d_{k}"], *(one[f"x_{i}_{k}"] for i in range(k))])
    return Gram(["1", *features], xx, xy, one[f"x_{k}_{k}"], one["w"])


def nonnegative_slope(x: Column, y: Column) -> Column:
    """max(0, sum xy / sum xx)."""
    return F.greatest(F.lit(0.0), S.rate(F.sum(x * y), F.sum(x * x)))


def group_equal_fit(rows: DataFrame, group: str, x: Column, y: Column, alpha: float) -> DataFrame:
    """Intercept and one penalised slope, groups weighing the same; the mean where x does not vary."""
    w = 1.0 / F.count("*").over(Window.partitionBy(group))
    data = rows.select(w.alias("w"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    m = data.agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw") + alpha)
    return m.select(slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"), (F.col("sy") / F.col("sw")).alias("constant"))


def collinearity(rows: DataFrame, features: Mapping[str, Column]) -> dict[str, float]:
    """Variance inflation of each feature from one Gram matrix."""
    names = list(features)
    g = next(iter(gram(rows, features, F.lit(0.0)).values()))
    out = {}
    for k, name in enumerate(names, start=1):
        rest = [i for i in range(len(names) + 1) if i != k]
        part = Gram(["1"] * len(rest), g.xx[np.ix_(rest, rest)], g.xx[rest, k], g.xx[k, k], g.weight)
        r2 = part.r_squared(part.ridge())
        out[name] = float("inf") if r2 >= 1 - 1e-12 else 1 / (1 - r2)
    return out


def spline_basis(x: Column, knots: Sequence[float]) -> dict[str, Column]:
    """Cubic truncated powers: x, x^2, x^3 and one term for each knot."""
    return {"x1": x, "x2": x * x, "x3": x * x * x} | {f"k{i}": F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), 3) for i, k in enumerate(knots)}


# -- model selection and calibration --------------------------------------------------------------------------------


def nested_cv(rows: DataFrame, source: str, features: Mapping[str, Column], target: Column, candidates: Mapping[str, tuple[Sequence[str], float]], outer: int = 5, inner: int = 4) -> DataFrame:
    """Nested cross-validation grouped by source: a row for each outer fold with the candidate that its inner folds select, and how that does on the fold.

    `candidates` maps an id to feature names and a ridge penalty; `target` is the log of a positive value. The best has the least
    mean of the sources' mean relative errors, then the least 90th percentile, then the first id. All fits come from
    sums by fold that are made in one pass; percentiles are within a thousandth of the ranks.
    """
    from gantry.operators.windows import balanced_folds

    spark, order = rows.sparkSession, list(candidates)
    data = rows.select(F.col(source).alias("source"), *(c.cast("double").alias(f"x_{k}") for k, c in features.items()), target.cast("double").alias("y"))
    sizes = data.groupBy("source").agg(F.count("*").alias("n"))
    outside = balanced_folds(sizes, "source", "n", min(outer, sizes.count())).withColumnRenamed("fold", "o")
    folds = sorted(r["o"] for r in outside.select("o").distinct().collect())
    placed = None
    for o in folds:
        left = sizes.join(outside.where(F.col("o") != o).select("source"), "source")
        part = balanced_folds(left, "source", "n", min(inner, left.count())).select("source", F.lit(o).alias("o"), F.col("fold").alias("i"))
        placed = part if placed is None else placed.unionByName(part)
    inside = data.join(placed, "source")
    x = {k: F.col(f"x_{k}") for k in features}
    cells = gram(inside.withColumn("cell", F.concat_ws("|", "o", "i")), x, F.col("y"), by="cell")
    position = {k: n + 1 for n, k in enumerate(features)}

    def coefficients(g: Gram, name: str) -> list[float]:
        chosen, alpha = candidates[name]
        at = [0, *(position[k] for k in chosen)]
        b = Gram(["1"] * len(at), g.xx[np.ix_(at, at)], g.xy[at], g.yy, g.weight).ridge(alpha)
        whole = np.zeros(len(features) + 1)
        whole[at] = b
        return [float(v) for v in whole]

    total = {o: functools.reduce(Gram.__add__, [g for k, g in cells.items() if k.split("|")[0] == str(o)]) for o in folds}
    names = ", ".join(f"b{k} double" for k in range(len(features) + 1))
    fits = [(o, int(cell.split("|")[1]), name, *coefficients(total[o] - g, name)) for o in folds for cell, g in cells.items() if cell.split("|")[0] == str(o) for name in order]
    inner_fits = F.broadcast(spark.createDataFrame(fits, f"o int, i int, candidate string, {names}"))  # folds by folds by candidates
    predicted = F.col("b0") + functools.reduce(operator.add, [F.col(f"b{position[k]}") * c for k, c in x.items()])
    error = F.abs(F.exp(predicted - F.col("y")) - 1)

    def measured(scored: DataFrame) -> DataFrame:
        by_source = scored.withColumn("e", error).groupBy("o", "candidate", "source").agg(F.avg("e").alias("m"))
        macro = by_source.groupBy("o", "candidate").agg(F.avg("m").alias("macro"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))
        return macro.join(scored.withColumn("e", error).groupBy("o", "candidate").agg(F.percentile_approx("e", 0.9, 1000).alias("p90"), F.count("*").alias("rows")), ["o", "candidate"])

    ranked = measured(inside.join(inner_fits, ["o", "i"]))
    best = {r["o"]: r for r in ranked.groupBy("o").agg(F.min(F.struct("macro", "p90", "candidate")).alias("m"), F.max("rows").alias("rows")).select("o", "m.*", "rows").collect()}
    chosen = [(o, best[o]["candidate"], float(best[o]["macro"]), int(best[o]["rows"]), *coefficients(total[o], best[o]["candidate"])) for o in folds]
    outer_fits = F.broadcast(spark.createDataFrame(chosen, f"o int, candidate string, inner_error double, train_rows long, {names}"))
    held = data.join(outside, "source").join(outer_fits, "o")
    return measured(held).join(outer_fits.select("o", "inner_error", "train_rows"), "o").select(F.col("o").alias("outer_fold"), "candidate", "inner_error", F.col("macro").alias("outer_error"), "train_rows", F.col("rows").alias("test_rows"), "sources")


def role_calibration(points: DataFrame, ident: str, role: str, features: Mapping[str, Column], ratio: Column, analytic: Column, observed: Column, least: int = 3, alpha: float = 1e-6) -> tuple[np.ndarray, DataFrame]:
    """log(ratio) fitted on calibration points and judged on holdout ones: coefficients, and points with `used_as`, prediction and error.

    Where calibration points are too few, holdout points that add most to the rank of the features (then the last id)
    are moved over. Points are profiler runs of a few jobs.
    """
    table = points.where(F.col(role).isin("calibration", "holdout")).select(F.col(ident).cast("string").alias("id"), F.col(role).alias("role"), *(c.cast("double").alias(f"x{k}") for k, c in enumerate(features.values())))
    known = {r: n for r, n in table.groupBy("role").count().collect()}
    moved: list[str] = []
    if known.get("calibration", 0) < least:
        rows = table.collect()  # fewer than `least` calibration points, and the holdout points that may make up for it
        x = {r["id"]: [1.0, *(r[f"x{k}"] for k in range(len(features)))] for r in rows}
        base, rest = [r["id"] for r in rows if r["role"] == "calibration"], {r["id"] for r in rows if r["role"] == "holdout"}
        while len(base) < least and rest:
            best = max(rest, key=lambda i: (np.linalg.matrix_rank(np.array([x[j] for j in [*base, i]])), i))
            rest.remove(best)
            base.append(best)
            moved.append(best)
        if len(base) < least:
            raise ValueError(f"fewer than {least} points to calibrate on")
    used = F.when(F.col(ident).cast("string").isin(moved), "fallback_calibration").otherwise(F.col(role))
    marked = points.where(F.col(role).isin("calibration", "holdout")).withColumn("used_as", used)
    beta = next(iter(gram(marked.where(F.col("used_as") != "holdout"), features, F.log(ratio)).values())).ridge(alpha)
    predicted = analytic * F.exp(linear(list(features.values()), beta))
    return beta, marked.withColumn("predicted", predicted).withColumn("error", F.abs(F.col("predicted") - observed) / observed)


def memory_tails(rows: DataFrame, selector: str, mode: str, residual: str, censored: Column, coverage: str, least: int) -> DataFrame:
    """For each selector the conformal upper bound of what its successes need beyond the centre, from the first of selector, mode and all rows that has `least` successes and is identifiable; and the floor that failures of this very selector set.

    selector, mode, level, tail, oom_floor, guard; a tail is never below 0, the guard is the larger of both.
    """
    good = rows.where(~censored)
    keys = rows.select(selector, mode).distinct()
    fine = conformal(good, [selector, mode], residual, coverage).select(selector, mode, F.col("n").alias("n0"), F.col("bound").alias("t0"))
    mid = conformal(good, [mode], residual, coverage).select(mode, F.col("n").alias("n1"), F.col("bound").alias("t1"))
    pooled = approximate_conformal(good, residual, coverage)
    floor = rows.where(censored).groupBy(selector, mode).agg(F.greatest(F.lit(0.0), F.max(residual)).alias("oom_floor"))
    out = keys.join(fine, [selector, mode], "left").join(mid, mode, "left").join(floor, [selector, mode], "left").join(F.broadcast(pooled))  # one row
    level = F.when((F.col("n0") >= least) & F.col("t0").isNotNull(), 0).when((F.col("n1") >= least) & F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2)
    tail = F.greatest(F.lit(0.0), F.when(level == 0, F.col("t0")).when(level == 1, F.col("t1")).when(level == 2, F.col("t2")))
    out = out.select(selector, mode, level.alias("level"), F.when(level.isNotNull(), tail).alias("tail"), "oom_floor")
    return out.withColumn("guard", F.when(F.col("tail").isNotNull() | F.col("oom_floor").isNotNull(), F.greatest(F.coalesce("tail", F.lit(0.0)), F.coalesce("oom_floor", F.lit(0.0)))))


def approximate_conformal(rows: DataFrame, value: str, coverage: str) -> DataFrame:
    """The conformal order statistic over all rows as one row (n2, t2), found by counting values instead of sorting rows in one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    n = counts.agg(F.sum("c").alias("n")).first()["n"] or 0
    rank = int((Decimal(n + 1) * Decimal(coverage)).to_integral_value(rounding="ROUND_CEILING"))
    if rank > n or not n:
        return rows.sparkSession.createDataFrame([(n, None)], "n2 long, t2 double")
    lo, hi = counts.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    below = 0
    while hi > lo:  # ever narrower bins of values hold the rank
        width = (hi - lo) / 4096
        if lo + width <= lo:
            break
        bin_of = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(4095))
        bins = sorted(counts.where(F.col("v").between(lo, hi)).groupBy(bin_of.alias("k")).agg(F.sum("c").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")).collect())
        for r in bins:
            if below + r["c"] >= rank:
                lo, hi = r["a"], r["b"]
                break
            below += r["c"]
    return rows.sparkSession.createDataFrame([(n, float(lo))], "n2 long, t2 double")


def joint_candidates(rows: DataFrame, keys: Sequence[str], outcome: str, predicted: str, limit: str, observed: str, rate: str, predicted_rate: str, multiplier: float) -> DataFrame:
    """Configurations with both their memory and their throughput: medians over replicates, whether prediction admits them and whether they were safe.

    A configuration that failed in any replicate was not safe.
    """
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("replicates"), S.median(predicted).alias("predicted_upper"), S.median(limit).alias("safe_limit"), S.median(observed).alias("observed"),
        S.median(rate).alias("rate"), S.median(predicted_rate).alias("predicted_rate"), S.median(F.col(predicted_rate) / F.lit(multiplier)).alias("predicted_rate_lower"),
        F.bool_or(F.col(outcome) == "oom").alias("failed"), F.bool_or(F.col(outcome) == "success").alias("_ran"),
    )
    admitted = F.coalesce(F.col("predicted_upper") <= F.col("safe_limit"), F.lit(False))
    safe = ~F.col("failed") & F.col("_ran") & F.coalesce(F.col("observed") <= F.col("safe_limit"), F.lit(False))
    return out.withColumns({"admitted": admitted, "safe": safe}).drop("_ran")


def _rankable() -> Column:
    return F.col("admitted") & (F.col("predicted_rate_lower") > 0) & (F.col("rate") > 0)


def gated_ranking(candidates: DataFrame, groups: Sequence[str], ident: str) -> DataFrame:
    """For each group the candidate that admission by memory and then the lower bound of throughput pick, against the best that was safe.

    From `joint_candidates`: candidates, real_safe, rankable, safety_failures (admitted, but failed or over the limit), selected,
    oracle, regret and hit. Nothing picked where something safe was measured is a regret of 1; with nothing safe there is none.
    """
    ok, safe = F.coalesce(_rankable(), F.lit(False)), F.coalesce(F.col("safe") & (F.col("rate") > 0), F.lit(False))
    over = F.coalesce(F.col("observed") > F.col("safe_limit"), F.lit(False))
    order = F.struct(F.col("predicted_rate_lower"), -F.col(ident))
    out = candidates.groupBy(*groups).agg(
        F.count("*").alias("candidates"), F.count_if(safe).alias("real_safe"), F.count_if(ok).alias("rankable"), F.count_if(F.col("admitted") & (F.col("failed") | over)).alias("safety_failures"),
        F.max_by(F.struct(F.col(ident).alias("id"), F.col("rate").alias("rate")), F.when(ok, order)).alias("_pick"), F.max(F.when(safe, F.col("rate"))).alias("oracle"),
    )
    regret = F.when(F.col("oracle").isNotNull(), F.when(F.col("_pick").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), (F.col("oracle") - F.col("_pick.rate")) / F.col("oracle"))))
    hit = F.when(F.col("oracle").isNotNull(), F.coalesce(F.col("_pick.rate") >= 0.9 * F.col("oracle"), F.lit(False)))
    return out.select(*groups, "candidates", "real_safe", "rankable", "safety_failures", F.col("_pick.id").alias("selected"), "oracle", regret.alias("regret"), hit.alias("hit"))


def scaling_pairs(candidates: DataFrame, scenario: str, cards: str, ident: str) -> DataFrame:
    """Per scenario the picks of N and of 2 N cards, both admitted: predicted and observed ratios and the log of how they differ."""
    pick = F.max_by(F.struct(F.col("predicted_rate").alias("p"), F.col("rate").alias("r")), F.struct(F.col("predicted_rate_lower"), -F.col(ident)))
    picked = candidates.where(_rankable() & (F.col("predicted_rate") > 0)).groupBy(scenario, cards).agg(pick.alias("x"))
    twice = picked.select(scenario, (F.col(cards) / 2).alias(cards), F.col("x").alias("y"))  # 2 N told as N
    both = picked.join(twice, [scenario, cards])
    predicted, observed = F.col("y.p") / F.col("x.p"), F.col("y.r") / F.col("x.r")
    return both.select(scenario, F.col(cards).alias("from_cards"), (F.col(cards) * 2).alias("to_cards"), predicted.alias("predicted_ratio"), observed.alias("observed_ratio"), F.log(observed / predicted).alias("residual"))


def scaling_claims(pairs: DataFrame, fold: str, coverage: str, least: float = 1.8) -> DataFrame:
    """Whether to claim that twice the cards give `least` times the rate: `pairs` with lower_ratio, claimed and cleared.

    A fold's predicted ratios are corrected by the lower conformal bound of the other folds' residuals; without one nothing is claimed.
    """
    folds = pairs.select(F.col(fold).alias("_held")).distinct()
    others = pairs.select(fold, "residual").join(folds, F.col(fold) != F.col("_held"))  # each pair once for every other fold
    bound = conformal(others, ["_held"], "residual", coverage, upper=False).select("_held", "bound")
    out = pairs.join(bound, F.col(fold) == F.col("_held"), "left")
    lower = F.col("predicted_ratio") * F.exp("bound")
    return out.select(*pairs.columns, lower.alias("lower_ratio"), F.coalesce(lower >= least, F.lit(False)).alias("claimed"), (F.col("observed_ratio") >= least).alias("cleared"))


def theory_calibration(rows: DataFrame, *, scenario: str, selector: str, mode: str, features: Mapping[str, Column], target: str, censored: Column, coverage: str, least: int, folds: int = 5) -> DataFrame:
    """Centre, tail and guard of a memory model in one go: rows with `center` (a fit of the log without the row's fold), `guard` by memory_tails of those residuals, and `upper`.

    Folds hold whole scenarios, so every residual is out of fold; the target of a censored row is what it needed at least.
    """
    held = rows.withColumn("_fold", F.pmod(F.xxhash64(scenario), F.lit(folds)).cast("int"))
    fits = left_out_fits(held.where(~censored), features, F.log(F.col(target)), "_fold", 1e-9)
    names = [f"b{i}" for i in range(len(features) + 1)]
    log_center = F.col("b0") + functools.reduce(operator.add, [F.col(b) * x for b, x in zip(names[1:], features.values(), strict=True)])
    scored = held.join(F.broadcast(fits), "_fold").withColumn("center", F.exp(log_center)).drop(*names)  # a row a fold
    scored = scored.withColumn("residual", F.col(target) - F.col("center"))
    tails = memory_tails(scored, selector, mode, "residual", censored, coverage, least).select(F.col(selector).alias("_selector"), F.col(mode).alias("_mode"), "level", "tail", "oom_floor", "guard")
    out = scored.join(tails, F.col(selector).eqNullSafe(F.col("_selector")) & F.col(mode).eqNullSafe(F.col("_mode")), "left").drop("_selector", "_mode", "_fold")
    return out.withColumn("upper", F.col("center") + F.col("guard"))


def compact_prediction(features: Mapping[str, Column], memory: Mapping[str, float], throughput: Mapping[str, float], *, cards: Column, stage: Column, margin: float, card_memory: float, reserve: float = 800.0, diverges: float = 40_000.0, trained: Mapping[str, tuple[Column, Sequence]] = {}) -> dict[str, Column]:
    """Memory centre and upper bound (MiB), admission, tokens a second and notes of a small fitted model; one card can't be sharded, and then all but the note is null."""
    dot = lambda w: functools.reduce(operator.add, [F.lit(float(v)) * (F.lit(1.0) if k == "1" else features[k]) for k, v in w.items()])
    possible = ~((cards == 1) & (stage >= 2))
    center = F.when(possible, dot(memory))
    upper = center + margin
    admitted = F.coalesce(upper + reserve < card_memory, F.lit(False))
    note = F.when(~possible, "sharding_needs_cards").when(center > diverges, "beyond_fit").when(~admitted, "too_close_to_limit")
    outside = F.array_compact(F.array(*(F.when(possible & ~c.isin(list(values)), F.lit(k)) for k, (c, values) in trained.items()))) if trained else F.array().cast("array<string>")
    return {"feasible": possible, "center": center, "upper": upper, "admitted": admitted, "rate": F.when(possible, F.exp(dot(throughput))), "note": note, "outside": outside}


# -- admission and evaluation ----------------------------------------------------------------------------------------


def admission(rows: DataFrame, center: Column, correction: Column, risk: Column, multiplier: float, safe: float) -> DataFrame:
    """center * e^correction and a guarded upper bound; admitted if the larger of both is within the safe amount."""
    out = rows.withColumn("center", center * F.exp(correction)).withColumn("upper", F.greatest(F.col("center"), risk * multiplier))
    return out.withColumn("admitted", F.col("upper") <= safe)


def multiplier_scan(rows: DataFrame, center: Column, failed: Column, observed: Column, capacity: float, candidates: Sequence[float]) -> DataFrame:
    """The multiplier that admits no failed row and covers most of the others; if none, the fewest false admits, then coverage."""
    grid = rows.select(center.alias("c"), failed.alias("f"), observed.alias("o")).withColumn("m", F.explode(F.array(*(F.lit(float(x)) for x in candidates))))
    per = grid.groupBy("m").agg(F.count_if(F.col("f") & (F.col("c") * F.col("m") <= capacity)).alias("false_admits"), F.avg(F.when(~F.col("f"), (F.col("c") * F.col("m") >= F.col("o")).cast("int"))).alias("coverage"))
    return per.orderBy("false_admits", F.col("coverage").desc(), "m").limit(1)


def folds(rows: DataFrame, scenario: str, ident: str, k: int) -> DataFrame:
    """Scenarios dealt to k folds in order of their names, and a digest of each fold's sorted test ids."""
    order = rows.select(scenario).distinct()
    order = order.withColumn("fold", F.pmod(F.dense_rank().over(Window.orderBy(scenario)) - 1, F.lit(k)))  # one row a scenario
    per = rows.join(order, scenario).groupBy("fold").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col(ident).cast("string"))).alias("ids"))
    return per.select("fold", "n", F.sha2(F.array_join("ids", "\n"), 256).alias("digest"))


def errors(rows: DataFrame, keys: Sequence[str], predicted: str, observed: str) -> DataFrame:
    """Mean, median and 90th percentile of the absolute relative error."""
    e = F.abs(F.col(predicted) - F.col(observed)) / F.abs(F.col(observed))
    return rows.groupBy(*keys).agg(F.avg(e).alias("mape"), F.median(e).alias("median"), S.percentile(e, 0.9).alias("p90"), F.count("*").alias("n"))


def evidence_gaps(rows: DataFrame, scenario: str, thresholds: Mapping[str, float]) -> DataFrame:
    """A row for each measure that misses its threshold."""
    gaps = F.array_compact(F.array(*(F.when(F.col(c) < t, F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("actual"), F.lit(float(t)).alias("required"))) for c, t in thresholds.items())))
    return rows.select(scenario, F.explode(gaps).alias("g")).select(scenario, "g.*")


def routed(rows: DataFrame, routes: Sequence[str], x: str, y: str, least: int, span: float) -> DataFrame:
    """A line of y on x for each row's finest route that can be fitted (rows and spread of x), then coarser ones, then all."""
    out, keys = rows, list(routes)
    fits = []
    for depth in range(len(keys), -1, -1):
        by = keys[:depth]
        fit = rows.groupBy(*by).agg(F.count("*").alias("_n"), (F.max(x) - F.min(x)).alias("_span"), F.regr_slope(y, x).alias(f"s{depth}"), F.regr_intercept(y, x).alias(f"i{depth}"))
        fit = fit.where((F.col("_n") >= least) & (F.col("_span") >= span) & F.col(f"s{depth}").isNotNull()).drop("_n", "_span")
        out = out.join(fit, by, "left") if by else out.join(F.broadcast(fit), how="left")  # one row at most
        fits.append(depth)
    predicted = F.coalesce(*(F.col(f"i{d}") + F.col(f"s{d}") * F.col(x) for d in fits))
    level = F.coalesce(*(F.when(F.col(f"s{d}").isNotNull(), F.lit(d)) for d in fits))
    return out.withColumn("predicted", predicted).withColumn("level", level).drop(*(f"{a}{d}" for d in fits for a in "si"))


def determinant_design(features: np.ndarray, k: int, most: int = 200_000) -> tuple[int, ...]:
    """k rows with the largest log det(I + X'X): all combinations up to `most`, else branch and bound from a greedy exchange, as exact."""
    n, d = features.shape
    score = lambda rows: np.linalg.slogdet(np.eye(d) + features[list(rows)].T @ features[list(rows)])[1]
    count = 1
    for i in range(k):
        count = count * (n - i) // (i + 1)
    if count <= most:
        return max(itertools.combinations(range(n), k), key=lambda rows: (round(score(rows), 12), tuple(-r for r in rows)))
    key = lambda rows: (round(score(rows), 12), tuple(-r for r in rows))
    chosen: list[int] = []
    for _ in range(k):
        chosen.append(max((i for i in range(n) if i not in chosen), key=lambda i: (score([*chosen, i]), -i)))
    best = tuple(sorted(chosen))
    while (better := max((tuple(sorted({*best} - {i} | {j})) for i in best for j in range(n) if j not in best), key=key, default=best)) and key(better) > key(best):
        best = better
    # a row gains less the more rows are chosen, so the largest gains of those left bound what a prefix can reach
    order = np.argsort(-(features**2).sum(axis=1), kind="stable")
    x = features[order]
    stack: list[tuple[int, ...]] = [()]
    while stack:
        prefix = stack.pop()
        first, room = (prefix[-1] + 1 if prefix else 0), k - len(prefix)
        matrix = np.eye(d) + x[list(prefix)].T @ x[list(prefix)]
        gains = np.log1p(np.einsum("ij,jk,ik->i", x[first:], np.linalg.inv(matrix), x[first:]))
        least = score(best) - np.linalg.slogdet(matrix)[1] - 1e-9
        if room == 1:
            for i in np.flatnonzero(gains >= least):
                best = max(best, tuple(sorted(int(order[r]) for r in (*prefix, first + i))), key=key)
            continue
        for i in range(len(gains) - room, -1, -1):  # the stack gives the first back first
            rest = gains[i + 1 :]
            if gains[i] + np.partition(rest, len(rest) - room + 1)[len(rest) - room + 1 :].sum() >= least:
                stack.append((*prefix, first + i))
    return best


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 500, memory: int = 8) -> np.ndarray:
    """Projected quasi-Newton (limited memory) within bounds; `f` gives value and gradient."""
    x = np.clip(start.astype(float), low, high)
    value, slope = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        if np.abs(slope[free]).max(initial=0.0) < 1e-9:
            break
        q, alphas = np.where(free, slope, 0.0), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            alphas.append(a)
            q = q - a * y
        if pairs:
            s, y = pairs[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q = q + s * (a - y @ q / (s @ y))
        step = -np.where(free, q, 0.0)
        if step @ slope >= 0:
            step = -np.where(free, slope, 0.0)
        size = 1.0
        while size > 1e-14:
            new = np.clip(x + size * step, low, high)
            new_value, new_slope = f(new)
            if new_value <= value + 1e-4 * slope @ (new - x):
                break
            size /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, y)]
        if value - new_value < 1e-13 * max(1.0, abs(value)):
            x = new
            break
        x, value, slope = new, new_value, new_slope
    return x


@dataclass
class StructuredFit:
    """Log throughput: Huber errors, pairwise order (logistic), listwise divergence and a prior, fitted together."""

    huber: float = 1.0
    pairwise: float = 0.5
    listwise: float = 0.5
    prior: float = 1e-3
    delta: float = 1.0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray, scenario: np.ndarray) -> StructuredFit:
        design = np.column_stack([np.ones(len(x)), x])
        groups = [np.flatnonzero(scenario == s) for s in np.unique(scenario)]

        def loss(b: np.ndarray) -> tuple[float, np.ndarray]:
            p = design @ b
            r = p - y
            inside = np.abs(r) <= self.delta
            value = self.huber * np.where(inside, r * r / 2, self.delta * (np.abs(r) - self.delta / 2)).mean() + self.prior * b[1:] @ b[1:] / 2
            by_p = self.huber * np.clip(r, -self.delta, self.delta) / len(r)
            for g in groups:
                if len(g) < 2:
                    continue
                d, t = p[g][:, None] - p[g][None, :], y[g][:, None] > y[g][None, :]
                n = max(t.sum(), 1)
                value += self.pairwise * np.where(t, np.logaddexp(0, -d), 0).sum() / n / len(groups)
                pull = np.where(t, -1 / (1 + np.exp(np.clip(d, -50, 50))), 0) / n / len(groups)
                by_p[g] += self.pairwise * (pull.sum(axis=1) - pull.sum(axis=0))
                want, have = np.exp(y[g] - y[g].max()), np.exp(p[g] - p[g].max())
                want, have = want / want.sum(), have / have.sum()
                value += self.listwise * (want * (np.log(want) - np.log(have))).sum() / len(groups)
                by_p[g] += self.listwise * (have - want) / len(groups)
            slope = design.T @ by_p
            slope[1:] += self.prior * b[1:]
            return value, slope

        start = np.linalg.lstsq(design, y, rcond=None)[0]
        bound = np.full(len(start), 50.0)
        self.coefficients = minimise(loss, start, -bound, bound)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), x]) @ self.coefficients


def tobit(x: np.ndarray, y: np.ndarray, censored: np.ndarray) -> np.ndarray:
    """Coefficients and log deviation of a linear model whose censored values are only known from below."""
    design = np.column_stack([np.ones(len(x)), x])
    from math import erf, pi, sqrt

    tail = np.vectorize(lambda z: max(0.5 * (1 - erf(z / sqrt(2))), 1e-300))

    def loss(b: np.ndarray) -> tuple[float, np.ndarray]:
        s = np.exp(b[-1])
        z = (y - design @ b[:-1]) / s
        t = tail(z)
        ratio = np.exp(-z * z / 2) / sqrt(2 * pi) / t
        value = -np.where(censored, np.log(t), -z * z / 2 - b[-1] - 0.5 * np.log(2 * pi)).sum()
        by_z = np.where(censored, ratio, z)
        return value, np.append(-design.T @ (by_z / s), -(by_z * z).sum() + (~censored).sum())

    first = np.linalg.lstsq(design, y, rcond=None)[0]
    start = np.append(first, np.log(max((y - design @ first).std(), 1e-6)))
    return minimise(loss, start, np.full(len(start), -1e6), np.full(len(start), 1e6))


def curve_fit(f: Callable, start: Sequence[float], x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Non-linear least squares by damped Gauss-Newton with numeric derivatives."""
    b, damp = np.array(start, dtype=float), 1e-3
    cost = ((f(x, b) - y) ** 2).sum()
    for _ in range(rounds):
        r = f(x, b) - y
        steps = np.maximum(np.abs(b), 1e-3) * 1e-6
        jac = np.column_stack([(f(x, b + np.eye(len(b))[k] * steps[k]) - f(x, b)) / steps[k] for k in range(len(b))])
        move = np.linalg.solve(jac.T @ jac + damp * np.diag(np.maximum(np.diag(jac.T @ jac), 1e-12)), -jac.T @ r)
        new = ((f(x, b + move) - y) ** 2).sum()
        if new < cost:
            done = cost - new < 1e-14 * max(cost, 1e-30)
            b, cost, damp = b + move, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return b


def subset_sweep(rows: DataFrame, features: Mapping[str, Column], target: Column, fold: str, most: int, alpha: float = 1e-6) -> list[tuple[float, tuple[str, ...]]]:
    """Held-out squared error of every subset of features, from one pass of sums by fold."""
    per = gram(rows, features, target, by=fold)
    total = None
    for g in per.values():
        total = g if total is None else total + g
    names = list(features)
    out = []
    for k in range(1, most + 1):
        for chosen in itertools.combinations(range(len(names)), k):
            at = [0, *(i + 1 for i in chosen)]
            loss = weight = 0.0
            for g in per.values():
                rest = total - g
                b = Gram(["1"] * len(at), rest.xx[np.ix_(at, at)], rest.xy[at], rest.yy, rest.weight).ridge(alpha)
                loss += g.yy - 2 * b @ g.xy[at] + b @ g.xx[np.ix_(at, at)] @ b
                weight += g.weight
            out.append((loss / weight, tuple(names[i] for i in chosen)))
    return sorted(out, key=lambda r: (round(r[0], 12), len(r[1]), r[1]))


def safety_threshold(scored: DataFrame, score: str, unsafe: Column) -> DataFrame:
    """The smallest score of an unsafe row; rows strictly below it are admitted."""
    cut = scored.agg(F.min(F.when(unsafe, F.col(score))).alias("threshold"))
    return scored.join(F.broadcast(cut)).withColumn("admitted", F.coalesce(F.col(score) < F.col("threshold"), F.lit(True)))  # one row
