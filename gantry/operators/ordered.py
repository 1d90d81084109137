"""Exact order statistics and pair counts of groups of any size: rows are sorted over all tasks by ranges, and only sums of ranges meet.

A range of the sorted rows is a task's; groups cross ranges as they like. What is told of a range (rows by group, or by group and
bucket) is small, and added up in order of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.session import materialise


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Equal keys, null being a key like any other."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _whole_groups(frames: Iterator[pd.DataFrame], names: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows with the numbers of those before them in their group and range, `_before`, added to `_n`."""
    last, seen = None, 0
    for pdf in frames:
        if not len(pdf):
            continue
        group = pdf[list(names)].apply(tuple, axis=1) if len(names) > 1 else pdf[names[0]] if names else pd.Series(0, index=pdf.index)
        codes = pd.factorize(group, use_na_sentinel=False)[0]
        n = pdf["_n"].to_numpy()
        total = np.cumsum(n)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        base = (total - n)[starts]
        before = total - n - np.repeat(base, np.diff(np.append(starts, len(pdf))))
        ends = [tuple(None if pd.isna(v) else v for v in pdf[list(names)].iloc[i]) for i in (0, -1)]
        if last == ends[0]:
            stop = starts[1] if len(starts) > 1 else len(pdf)
            before[:stop] += seen
        yield pdf.assign(_before=before)
        last, seen = ends[1], int(before[-1] + n[-1])


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with their numbers in their group from 0, by `order`; a group is spread over ranges, each of which knows how many rows came before."""
    keys, by = list(keys), [*keys, *order]
    placed = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_in"))
    w = Window.partitionBy(*keys).orderBy("_range")
    starts = sizes.select(*keys, "_range", (F.sum("_in").over(w) - F.col("_in")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1
    numbered = placed.withColumn("_within", within).alias("p").join(starts.alias("s"), _same("p", "s", [*keys, "_range"]))
    return numbered.select(*(F.col(f"p.{c}").alias(c) for c in rows.columns), (F.col("_start") + F.col("_within")).alias(name))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], times: str | None = None) -> DataFrame:
    """Exact percentiles of each group, interpolated as `percentile` does, and `_count`, its values; no group is held anywhere.

    Nulls don't count, and a group of nulls alone is not there. Equal values are counted before they are sorted; with `times`, a
    row stands for that many.
    """
    keys = list(keys)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    dealt = counted.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*dealt.schema, T.StructField("_before", T.LongType())])
    placed = materialise(dealt.mapInPandas(lambda frames: _whole_groups(frames, keys), schema), "sorted")
    ranges = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in"))
    by = Window.partitionBy(*keys)
    ranges = ranges.select("*", (F.sum("_in").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).alias("_start"), F.sum("_in").over(by).alias("_count"))
    ranges = materialise(ranges, "ranges")
    at = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_count") - 1)).alias("at")) for name, q in shares.items()))
    wanted = ranges.select(*keys, "_range", "_start", "_in", "_count", F.explode(at).alias("w"))
    ends = F.array(F.floor("w.at"), F.ceil("w.at"))
    wanted = wanted.select("*", F.explode(F.array_distinct(ends)).alias("_rank")).where("_rank >= _start AND _rank < _start + _in")
    found = placed.alias("p").join(wanted.alias("r"), _same("p", "r", keys) & (F.col("p._range") == F.col("r._range")) & (F.col("_rank") - F.col("_start") >= F.col("_before")) & (F.col("_rank") - F.col("_start") < F.col("_before") + F.col("_n")))
    found = found.select(*(F.col(f"r.{k}").alias(k) for k in keys), "_count", "w.name", "w.at", "_rank", "_v")
    # the values at both ends, weighed by how near they are
    near = F.when(F.floor("at") == F.ceil("at"), F.col("_v")).otherwise(F.col("_v") * (1 - F.abs(F.col("at") - F.col("_rank"))))
    each = lambda name: F.sum(F.when(F.col("name") == name, near)).alias(name)
    return found.groupBy(*keys).agg(F.first("_count").alias("_count"), *(each(name) for name in shares)).where("_count IS NOT NULL")


def dominance(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
    """Weight of the pairs of which one is smaller in both; counted by merging neighbouring blocks in order of y."""
    order = np.lexsort((-x, y))  # of equal y the larger x comes first and is never smaller
    x, w = np.unique(x, return_inverse=True)[1][order].astype(np.int64), weight[order].astype(np.int64)
    out, block, top = 0, 1, int(x.max(initial=0)) + 1
    while block < len(x):
        number = np.arange(len(x)) // block
        key, left = (number // 2) * top + x, number % 2 == 0
        by = np.argsort(key[left], kind="stable")
        before, ranked = np.concatenate([[0], np.cumsum(w[left][by])]), key[left][by]
        right = ~left
        smaller = before[np.searchsorted(ranked, key[right])] - before[np.searchsorted(ranked, (number[right] // 2) * top)]
        out += int((smaller * w[right]).sum())
        block *= 2
    return out


def ordered_pairs(rows: DataFrame, keys: Sequence[str], x: str, y: str, most: int = 1 << 20) -> DataFrame:
    """For each group, `pairs` of rows that differ in y and how many of them, `correct`, have x in the same order; a tie in x is none.

    Groups of up to `most` different rows are counted in one task each. Larger ones are dealt into buckets by (x, y): pairs
    within a bucket are counted there, and pairs across buckets by sorting once more by y, where each range knows how many rows
    of each bucket came in earlier ranges. Rows with a null in x or y are left out.
    """
    keys = list(keys)
    per = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    per = materialise(per, "values")
    size = per.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum("_n").alias("_all")).where("_rows > 0")
    ties = per.groupBy(*keys, "_y").agg(F.sum("_n").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t")).alias("_ties"))
    totals = size.alias("s").join(ties.alias("t"), _same("s", "t", keys)).select(*(F.col(f"s.{k}").alias(k) for k in keys), "_rows", F.expr("(_all * _all - _ties) div 2").alias("pairs"))
    totals = materialise(totals, "totals")
    fields = [per.schema[k] for k in keys]
    counted = T.StructType([*fields, T.StructField("correct", T.LongType())])
    of = lambda big: per.alias("p").join(totals.where(F.col("_rows") > most if big else F.col("_rows") <= most).alias("t"), _same("p", "t", keys)).select("p.*")

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].iloc[:1].assign(correct=dominance(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_n"].to_numpy()))

    correct = of(False).groupBy(*keys).applyInPandas(small, counted)
    if not totals.where(F.col("_rows") > most).isEmpty():
        correct = correct.unionByName(_across_ranges(of(True), keys, counted))
    sums = correct.groupBy(*keys).agg(F.sum("correct").alias("correct"))
    return totals.alias("t").join(sums.alias("c"), _same("t", "c", keys), "left").select(*(F.col(f"t.{k}").alias(k) for k in keys), "pairs", F.coalesce("correct", F.lit(0)).alias("correct"))


def _across_ranges(per: DataFrame, keys: list[str], counted: T.StructType) -> DataFrame:
    """Counts to be added up by group: within buckets, across them, and less the pairs that tie in x."""
    fields = list(counted.fields[:-1])
    placed = materialise(per.repartitionByRange(*keys, "_x", "_y").sortWithinPartitions(*keys, "_x", "_y").withColumn("_b", F.spark_partition_id().cast("long")), "buckets")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        # in order of (x, y), so that pairs that tie in x count here and are taken off below
        order = np.empty(len(pdf), dtype=np.int64)
        order[np.lexsort((pdf["_y"].to_numpy(), pdf["_x"].to_numpy()))] = np.arange(len(pdf))
        return pdf[keys].iloc[:1].assign(correct=dominance(order, pdf["_y"].to_numpy(), pdf["_n"].to_numpy()))

    within = placed.groupBy(*keys, "_b").applyInPandas(inside, counted)
    tied = per.groupBy(*keys, "_x").agg(F.expr("(sum(_n) * sum(_n) - sum(_n * _n)) div 2").alias("t"))
    tied = tied.groupBy(*keys).agg((-F.sum("t")).alias("correct"))
    # of equal y the larger x comes first: its bucket is never below that of those behind it
    ranked = materialise(placed.repartitionByRange(*keys, "_y", F.col("_x").desc()).withColumn("_q", F.spark_partition_id().cast("long")), "ranges")
    sums = ranked.groupBy(*keys, "_q", "_b").agg(F.sum("_n").alias("_w"))
    lists = sums.groupBy(*keys, "_q").agg(F.sort_array(F.collect_list(F.struct("_b", "_w"))).alias("_w"))
    before = T.StructType([*fields, T.StructField("_q", T.LongType()), T.StructField("_at", T.ArrayType(T.LongType())), T.StructField("_sum", T.ArrayType(T.LongType()))])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != group:
                    group, total = now, {}
                at = sorted(total)
                out.append({k: row[k] for k in keys} | {"_q": row["_q"], "_at": at, "_sum": np.cumsum([total[b] for b in at], dtype=np.int64).tolist()})
                for w in row["_w"]:
                    total[w["_b"]] = total.get(w["_b"], 0) + w["_w"]
            from pyspark.sql.pandas.types import to_arrow_schema

            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(before))

    earlier = lists.repartition(*keys) if keys else lists.repartition(1)
    earlier = earlier.sortWithinPartitions(*keys, "_q").mapInArrow(running, before)

    def across(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({f.name: [] for f in counted})
        b, w = pdf["_b"].to_numpy(), pdf["_n"].to_numpy()
        at, sums = (np.asarray(told[c].iloc[0], dtype=np.int64) for c in ("_at", "_sum"))
        lower = np.concatenate([[0], sums])[np.searchsorted(at, b)]
        return pdf[keys].iloc[:1].assign(correct=int((lower * w).sum()) + dominance(b, pdf["_y"].to_numpy(), w))

    between = ranked.groupBy(*keys, "_q").cogroup(earlier.groupBy(*keys, "_q")).applyInPandas(across, counted)
    return within.unionByName(between).unionByName(tied)
