"""Support domains of two components: where they agree, where they differ, and what each request may have of both.

A domain is a long table: component, dimension, value (an allowed value as text), number (the same as a number, else
null), low and high (an inclusive range instead of values). A dimension that a component doesn't name is not constrained by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.operators.relational import reasons

#: Why a request is not served by a component.
OUTSIDE_FIRST, OUTSIDE_SECOND = "outside_predictor_support_grid", "outside_packing_release_domain"
_POINT = "struct<number:double,value:string>"


def reconcile(domain: DataFrame, first: str, second: str) -> DataFrame:
    """For each dimension of `first`: agree_on, first_only, second_only, boundary_absent, constrained and conflict.

    Against a range of `second` the first one's numbers within it agree, those above it are its own, and an upper bound that is none of
    its numbers is absent from its grid. Against values, sets are compared. Without any, all agree.
    """
    point = F.struct(F.col("number").alias("number"), F.col("value").alias("value"))
    of = lambda c: F.sort_array(F.collect_set(F.when((F.col("component") == c) & F.col("value").isNotNull(), point)))
    bound = lambda name: F.max(F.when(F.col("component") == second, F.col(name)))
    rows = domain.groupBy("dimension").agg(of(first).alias("a"), of(second).alias("b"), bound("low").alias("low"), bound("high").alias("high")).where(F.size("a") > 0)
    ranged, listed, none = F.col("high").isNotNull(), F.size("b") > 0, F.array().cast(f"array<{_POINT}>")
    within = lambda p: (p["number"] >= F.col("low")) & (p["number"] <= F.col("high"))
    absent = F.filter(F.array(F.struct(F.col("high").alias("number"), F.format_string("%.0f", "high").alias("value"))), lambda p: ~F.exists("a", lambda x: x["number"] == p["number"]))
    pick = lambda of_range, of_list, of_none: F.when(ranged, of_range).when(listed, of_list).otherwise(of_none)
    rows = rows.select(
        "dimension", (ranged | listed).alias("constrained"), F.col("a").alias("first"),
        pick(F.filter("a", within), F.array_intersect("a", "b"), F.col("a")).alias("agree_on"),
        pick(F.filter("a", lambda p: p["number"] > F.col("high")), F.array_except("a", "b"), none).alias("first_only"),
        pick(none, F.array_except("b", "a"), none).alias("second_only"), pick(absent, none, none).alias("boundary_absent"),
    )
    differs = (F.size("first_only") + F.size("second_only") + F.size("boundary_absent")) > 0
    plain = [F.transform(c, lambda p: p["value"]).alias(c) for c in ("first", "agree_on", "first_only", "second_only", "boundary_absent")]
    return rows.select("dimension", "constrained", *plain, differs.alias("conflict"))


def classify(requests: DataFrame, reconciled: DataFrame, first_by: Sequence[str], both_by: Sequence[str]) -> DataFrame:
    """`requests` with first_available, second_available, support (`strong` where both serve it, `weak` one, else `outside`) and reasons.

    A request is served by the first component if it is within its values in the dimensions `first_by`, by the second if
    it is where both agree in `both_by`; columns have the dimensions' names. A missing value is outside.
    """
    wanted = sorted({*first_by, *both_by})
    told = reconciled.where(F.col("dimension").isin(wanted))
    # one row: a map from the few dimensions to their values
    one = told.agg(F.map_from_entries(F.collect_list(F.struct("dimension", "first"))).alias("_first"), F.map_from_entries(F.collect_list(F.struct("dimension", "agree_on"))).alias("_both"))
    inside = lambda name, dims: _all(F.coalesce(F.array_contains(F.col(name)[d], F.col(d).cast("string")), F.lit(False)) for d in dims)
    rows = requests.join(F.broadcast(one)).withColumns({"first_available": inside("_first", first_by), "second_available": inside("_both", both_by)}).drop("_first", "_both")
    a, b = F.col("first_available"), F.col("second_available")
    return rows.withColumns({"support": F.when(a & b, "strong").when(a | b, "weak").otherwise("outside"), "reasons": reasons({OUTSIDE_FIRST: ~a, OUTSIDE_SECOND: ~b})})


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
