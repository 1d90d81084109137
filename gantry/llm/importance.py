"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k on the log ratio.

Words and pairs of words are hashed into a fixed number of buckets. Two generative models, of the target rows
(labelled good and not toxic) and of all rows, give each document the log of its likelihood ratio; with a Gumbel
variate of its id added, the largest keys are a sample without replacement by importance weight.

Cases: a null or empty text has no features and a weight of 0; null labels count as no label, and so do ids that are
none of the documents' type; ids are of any type; rows that tie at the cut all stay; repeated rows have the same key;
an empty table gives an empty result, and with no target row every weight is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import add_columns, byte_chunks, column_bytes, materialise, mix64, text_batches, word_hashes

_U = np.uint64


def features(buffer: np.ndarray, start: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and of every pair of neighbouring words in a text."""
    words, owner = word_hashes(buffer, start)
    same = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = mix64(words[same] * _U(3) + words[same + 1] * _U(0x9E3779B97F4A7C15))
    return (np.concatenate([words, pairs]) % _U(buckets)).astype(np.int64), np.concatenate([owner, owner[same]])


def target_ids(labels: DataFrame, most: int, doc_id: str, kind: T.DataType) -> tuple[DataFrame, float]:
    """At most `most` distinct target ids as `_target`, of the documents' type (a bounded, documented sample of the labels), and the targets' share of all labels."""
    labels = labels.select(F.col(doc_id).try_cast(kind).alias("_target"), F.col("quality").alias("q"), F.coalesce("toxic", F.lit(0)).alias("t"))
    good = (F.col("q") == 1) & (F.col("t") == 0)
    labels = labels.where(F.col("_target").isNotNull() & F.col("q").isNotNull())
    one = labels.agg(F.count("*").alias("n"), F.sum(F.when(good, 1).otherwise(0)).alias("k")).first()
    picked = materialise(labels.where(good).select("_target").distinct().orderBy(F.xxhash64("_target"), "_target").limit(most), "targets")
    return picked, ((one["k"] or 0) / one["n"] if one["n"] else 1.0)


def log_ratios(docs: DataFrame, targets: DataFrame, *, text: str = "text", doc_id: str = "doc_id", buckets: int = 10_000, smooth: float = 1.0) -> np.ndarray:
    """log(target / raw) for each bucket; the raw model counts all rows."""

    def count(batches):
        raw, good = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in text_batches(batches, "text"):
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, buffer, start, _ in byte_chunks(column_bytes(batch, "text")):
                bucket, owner = features(buffer, start, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[chosen[first:last][owner]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at], pa.int64()), pa.array(good[at], pa.int64())], names=["bucket", "raw", "good"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    marked = rows.join(F.broadcast(targets), F.col("id") == F.col("_target"), "left")  # at most `most_targets` ids
    found = marked.select("text", F.col("_target").isNotNull().alias("chosen")).mapInArrow(count, "bucket int, raw long, good long")
    found = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.full(buckets, smooth), np.full(buckets, smooth)
    at = found.column("bucket").to_numpy()
    raw[at] += found.column("raw").to_numpy()
    good[at] += found.column("good").to_numpy()
    if good.sum() == smooth * buckets:
        return np.zeros(buckets, dtype=np.float32)
    return (np.log(good / good.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def with_weights(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with `log_weight`, the log likelihood ratio of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # `buckets` numbers

    def make():
        def run(batch: pa.RecordBatch) -> list:
            parts = []
            for first, last, buffer, start, _ in byte_chunks(column_bytes(batch, text)):
                bucket, owner = features(buffer, start, len(shared.value))
                parts.append(np.bincount(owner, weights=shared.value[bucket], minlength=last - first))
            return [np.concatenate(parts)]

        return run

    return add_columns(docs, [T.StructField("log_weight", T.DoubleType())], make, text)


def gumbel(key: Column, seed: int = 0) -> Column:
    """A Gumbel variate that depends on the key and the seed alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def top_k_cut(rows: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th largest key, by counting in ever narrower bins; nothing is sorted as a whole."""
    if k <= 0:
        return float("inf")
    span = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if k >= span["n"]:
        return float("-inf")
    lo, hi = span["lo"], span["hi"]
    for _ in range(6):
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        bin_of = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        counts = rows.where(F.col(key).between(lo, hi)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["b"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        lo, hi, left = r["lo"], r["hi"], r["n"]
        if left == 1 or lo == hi:
            return lo
    return lo


def resample(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", share: float | None = None, most_targets: int = 20_000, buckets: int = 10_000, seed: int = 0) -> DataFrame:
    """`docs` without its text, with `log_weight`, `gumbel_key` and `kept`.

    `share` of the rows are kept; where none is given, as large a share as targets have in the labels. The target
    model is fitted on at most `most_targets` labelled rows.
    """
    targets, of_labels = target_ids(labels, most_targets, doc_id, docs.schema[doc_id].dataType)
    ratios = log_ratios(docs, targets, text=text, doc_id=doc_id, buckets=buckets)
    keyed = with_weights(docs, ratios, text).drop(text).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col(doc_id), seed))
    keyed = materialise(keyed, "keys")
    cut = top_k_cut(keyed, "gumbel_key", round((of_labels if share is None else share) * keyed.count()))
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(cut))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return resample(docs, labels).select("doc_id", "log_weight", "gumbel_key", "kept")
