"""Incremental ingestion: tailing folders, idempotent replay, dirty keys, attempt fencing and job states."""

from __future__ import annotations

import time as clocks
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.operators.relational import last_wins


def tail(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 64, newest_first: bool = False) -> DataFrame:
    """A stream of JSON-lines files that land whole (written beside, then renamed), so no half line is ever read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("latestFirst", newest_first).json(path)


def poll(scan: Callable[[], int], rounds: int, wait: float, sleep: Callable[[float], None] = clocks.sleep) -> list[tuple[int, str | None]]:
    """Scan again and again: what each round found, and its error; an error is kept and the next round goes on."""
    out: list[tuple[int, str | None]] = []
    for k in range(rounds):
        try:
            out.append((scan(), None))
        except Exception as e:  # noqa: BLE001  a broken file must not end the loop
            out.append((0, f"{type(e).__name__}: {e}"))
        if k < rounds - 1:
            sleep(wait)
    return out


def changes(revision: Callable[[], int], rounds: int, wait: float, beat: float = 15.0, clock: Callable[[], float] = clocks.monotonic, sleep: Callable[[float], None] = clocks.sleep) -> Iterator[tuple[str, int]]:
    """("revision", n) whenever the revision has changed, ("heartbeat", n) where nothing was said for `beat` seconds."""
    last, said = None, clock()
    for _ in range(rounds):
        now = revision()
        if now != last or clock() - said >= beat:
            yield ("revision" if now != last else "heartbeat"), now
            last, said = now, clock()
        sleep(wait)


def keyed(events: DataFrame, *parts: Column) -> DataFrame:
    """`event_key`: the same for the same event, however often it is read."""
    return events.withColumn("event_key", F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256))


def once(events: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each event key once; with a time column the state is bounded by a watermark."""
    if time is None:
        return events.dropDuplicates(["event_key"])
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_key"])


def cold_start(events: DataFrame, order: Sequence[str], most: int = 256) -> DataFrame:
    """Without a cursor only the last events are replayed."""
    return events.orderBy(*(F.col(c).desc() for c in order)).limit(most)


def fenced(events: DataFrame, job: str, time: str, begins: Column) -> DataFrame:
    """Without events older than the start of their job's current attempt (a cut of each key, not a watermark)."""
    start = F.max(F.when(begins, F.col(time))).over(Window.partitionBy(job))
    return events.withColumn("_start", start).where(F.col("_start").isNull() | (F.col(time) >= F.col("_start"))).drop("_start")


def latest_states(events: DataFrame, job: str, status: str, time: str, order: str, terminal: Sequence[str] = ("success", "failed", "oom")) -> DataFrame:
    """State of each job after its events in order: planned, running, then terminal; nothing follows a terminal but a new start.

    That is the first terminal state since the last start, else the last state since it: three aggregates and no list of events.
    """
    at, s = F.struct(F.col(time).alias("t"), F.col(order).alias("o")), F.col(status)
    known = events.where(s.isNotNull()).select(F.col(job).alias("_job"), at.alias("_at"), s.alias("_s"))
    start = known.groupBy("_job").agg(F.max(F.when(F.col("_s") == "running", F.col("_at"))).alias("_start"))
    since = known.join(start, "_job").where(F.col("_start").isNull() | (F.col("_at") >= F.col("_start")))
    ends = F.col("_s").isin(list(terminal))
    last = since.groupBy("_job").agg(F.min_by("_s", F.when(ends, F.col("_at"))).alias("_end"), F.max_by("_s", "_at").alias("_last"), F.max(ends.cast("int")).alias("_ended"))
    counts = events.groupBy(job).agg(F.count("*").alias("events"))
    out = counts.join(last, F.col(job) == F.col("_job"), "left")
    return out.select(job, F.when(F.col("_ended") == 1, F.col("_end")).otherwise(F.coalesce("_last", F.lit("planned"))).alias("state"), "events")


def fold_attempts(events: DataFrame, job: str = "job_id", time: str = "time_unix", event: str = "event", tokens: str = "tokens") -> DataFrame:
    """The streaming twin of `fenced`: state by job holds the attempt's start and its sums; a `train_begin` resets it."""
    out = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("started", T.DoubleType()), T.StructField("steps", T.LongType()), T.StructField("tokens", T.LongType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        started, steps, total = state.get if state.exists else (float("-inf"), 0, 0)
        for pdf in batches:
            for at, kind, n in pdf.sort_values(time)[[time, event, tokens]].itertuples(index=False):
                if kind == "train_begin" and at > started:
                    started, steps, total = at, 0, 0
                elif kind == "step_end" and at >= started:
                    steps, total = steps + 1, total + int(n or 0)
        state.update((float(started), int(steps), int(total)))
        yield pd.DataFrame({"job_id": [key[0]], "started": [started], "steps": [steps], "tokens": [total]})

    return events.groupBy(job).applyInPandasWithState(run, out, "started double, steps long, tokens long", "update", "NoTimeout")


def upsert_batches(path: str, keys: Sequence[str], order: Sequence[str], recompute: Callable[[DataFrame], DataFrame] | None = None, derived: str | None = None) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` that lands each batch once and recomputes the derived rows of its keys alone.

    A batch is a folder of its own under `path`, so that running it again replaces it; the newest row of a key wins.
    The derived table holds a version for each batch; `current` reads the last of each key.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
        if recompute is not None and derived is not None:
            spark = batch.sparkSession
            dirty = batch.select(keys[0]).distinct()
            history = last_wins(spark.read.option("basePath", path).parquet(path).drop("batch"), keys, order).join(dirty, keys[0], "left_semi")
            recompute(history).withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{derived}/version_of={number:012d}")

    return write


def current(spark: SparkSession, derived: str, key: str) -> DataFrame:
    rows = spark.read.option("basePath", derived).parquet(derived).drop("version_of")
    return last_wins(rows, [key], ["version"]).drop("version")


def live(rows: DataFrame, time: str, status: str, now: Column, most: float = 10.0) -> DataFrame:
    """Fresh and running."""
    return rows.withColumn("age", now - F.col(time)).withColumn("live", (F.col("age") <= most) & (F.col(status) == "running"))


def merged_health(rows: DataFrame, campaign: str, state: str, time: str) -> DataFrame:
    """One row over all campaigns: how many there are, how many fail, the worst state and the latest time."""
    worst = F.max_by(state, F.array_position(F.array(*map(F.lit, ("ok", "stale", "error"))), F.col(state)))
    return rows.agg(F.count_distinct(campaign).alias("campaigns"), F.count_if(F.col(state) == "error").alias("failing"), worst.alias("state"), F.max(time).alias("latest"))


def fan_in(streams: dict[str, DataFrame]) -> DataFrame:
    """Several campaigns as one stream, each row with its campaign."""
    out = None
    for name, df in streams.items():
        part = df.withColumn("campaign_id", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


class Revisions:
    """Counts a query's finished batches and tells those who ask; errors are kept, not raised."""

    def __init__(self, spark: SparkSession):
        from pyspark.sql.streaming import StreamingQueryListener

        outer = self
        self.revision, self.last_error = 0, None

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                outer.revision += int(event.progress.numInputRows > 0)

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                outer.last_error = event.exception or outer.last_error

        self._listener = Listener()
        spark.streams.addListener(self._listener)
