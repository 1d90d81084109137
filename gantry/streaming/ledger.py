"""Batches with a ledger: what each one did, which revision it made, and its error if it failed; the next one runs anyway."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "batch long, rows long, error string, finished timestamp"


def kept(apply: Callable[[DataFrame, int], None], path: str, clock: Callable[[], float] | None = None) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` that runs `apply` and writes one row to the ledger under `path`; an error is kept there, not raised.

    A batch's row is a folder of its own, so that a batch that is run again after a restart replaces it.
    """
    import time

    def run(batch: DataFrame, number: int) -> None:
        spark, error, n = batch.sparkSession, None, 0
        try:
            n = batch.count()
            if n:
                apply(batch, number)
        except Exception as e:  # noqa: BLE001  whatever a batch meets, the next one has to run
            error = f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"
        row = spark.createDataFrame([(number, n, error, float((clock or time.time)()))], "batch long, rows long, error string, at double")
        row.select("batch", "rows", "error", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("finished")).coalesce(1).write.mode("overwrite").parquet(f"{path}/n={number:012d}")

    return run


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch, rows, error, finished and revision: the number of batches up to this one that had rows and did not fail."""
    rows = spark.read.schema(f"{SCHEMA}, n long").option("basePath", path).parquet(path).drop("n")
    changed = F.col("error").isNull() & (F.col("rows") > 0)
    days = rows.groupBy(F.col("batch").bitwiseAND(~0xFFF).alias("_run")).agg(F.count_if(changed).alias("_n"))
    # runs of 4096 batches count by themselves; only one row of each goes through one task
    before = days.select("_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_run", F.col("batch").bitwiseAND(~0xFFF))
    inside = F.count_if(changed).over(Window.partitionBy("_run").orderBy("batch"))
    return rows.withColumn("_inside", inside).join(before, "_run").select("batch", "rows", "error", "finished", (F.col("_before") + F.col("_inside")).alias("revision"))


def notices(entries: DataFrame, until: str | None = None, beat: float = 15.0) -> DataFrame:
    """What a listener is told: kind (`revision`, `error` or `heartbeat`), revision and at.

    Every new revision and every error at once, and a heartbeat whenever `beat` seconds have passed since the last notice,
    up to the next one, or `until` behind the last.
    """
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("rows") > 0, "revision")
    said = entries.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("batch", "kind", "revision", F.col("finished").alias("at"))
    said = said.withColumn("following", F.lead("at").over(Window.orderBy("at", "batch")))
    last, micros = F.lit(until).cast("timestamp"), int(beat * 1e6)
    # a notice at the very time of a beat takes its place
    lasts = F.unix_micros(F.coalesce("following", last, "at")) - F.unix_micros("at") - F.when(F.col("following").isNull(), 0).otherwise(1)
    silent = F.greatest(F.floor(lasts / micros), F.lit(0))
    beats = F.transform(F.sequence(F.lit(0), silent.cast("int")), lambda k: F.struct(F.when(k == 0, F.col("kind")).otherwise("heartbeat").alias("kind"), F.col("revision").alias("revision"), F.timestamp_micros(F.unix_micros("at") + k * micros).alias("at")))
    return said.select(F.explode(beats).alias("n")).select("n.*")
