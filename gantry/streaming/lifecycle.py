"""The life of jobs as keyed state: attempts fence off what came before, terminal states hold, silent jobs become stale.

State of a job is small and does not depend on the order of its events: the latest start, the latest event, and the
terminal events since that start. A start that comes late only moves the fence; what it fences off is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("success", "failed", "oom")
STARTED = "running"
#: What is emitted of a job; `started` and `seen` are microseconds, `stale` is true where the timer ran out.
LIFE = "job string, state string, started long, seen long, events long, stale boolean"


class JobLife(StatefulProcessor):
    """Rows job, at (microseconds), seq and status (null where an event tells no state) to the job's state after them."""

    def __init__(self, silence_ms: int, event_time: bool):
        self.silence, self.event_time = silence_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        end = T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType())])
        # one value, as each call to the store costs more than the state's size
        self.life = handle.getValueState("life", T.StructType([T.StructField(n, k) for n, k in (
            ("start_at", T.LongType()), ("start_seq", T.LongType()), ("last_at", T.LongType()), ("last_seq", T.LongType()),
            ("last", T.StringType()), ("seen", T.LongType()), ("events", T.LongType()), ("timer", T.LongType()), ("ends", T.ArrayType(end)))]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        start, last, status, seen, events, timer, ends = None, None, None, None, 0, None, []
        known = self.life.get()
        if known is not None:
            a, b, c, d, status, seen, events, timer, ends = known
            start, last, ends = (None if a is None else (a, b)), (None if c is None else (c, d)), [tuple(e) for e in ends]
        for row in rows:
            at, seq, told, events = row["at"], row["seq"], row["status"], events + 1
            seen = at if seen is None else max(seen, at)
            if told is None:
                continue
            if last is None or (at, seq) > last:
                last, status = (at, seq), told
            if told == STARTED and (start is None or (at, seq) > start):
                start = (at, seq)
            elif told in TERMINAL:
                ends.append((at, seq, told))
        ends = sorted(e for e in ends if start is None or e[:2] >= start)
        if timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        state = ends[0][2] if ends else status or "planned"
        if state == STARTED:
            timer = (seen // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.silence
            if self.event_time and timer <= timerValues.getCurrentWatermarkInMs():
                timer = timerValues.getCurrentWatermarkInMs() + 1
            self.handle.registerTimer(timer)
        self.life.update((*(start or (None, None)), *(last or (None, None)), status, seen, events, timer, ends))
        yield self._row(key, state, start, seen, events, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.life.get()
        if known is None:
            return
        a, b, c, d, status, seen, events, timer, ends = known
        if timer is not None and expiredTimerInfo.getExpiryTimeInMs() == timer:
            self.life.update((a, b, c, d, status, seen, events, None, ends))
            yield self._row(key, STARTED, None if a is None else (a, b), seen, events, True)

    @staticmethod
    def _row(key: tuple, state: str, start: tuple | None, seen: int | None, events: int, stale: bool) -> Row:
        return Row(job=key[0], state=state, started=start and start[0], seen=seen, events=events, stale=stale)

    def close(self) -> None:
        pass


def use_rocks(spark: SparkSession) -> None:
    """Keyed state with timers needs a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def job_lives(events: DataFrame, job: str, status: str, time: str, order: str, silence: float = 10.0, delay: str | None = None) -> DataFrame:
    """A stream with the state of each job after each batch that has events of it, as `latest_states` gives it for all events so far.

    A running job that is silent for `silence` seconds gives one more row with `stale`: by the clock, or, with `delay`, by event
    time under a watermark of that delay, which later events than that miss.
    """
    use_rocks(events.sparkSession)
    own = F.col(job).cast("string").alias("job"), F.col(order).cast("long").alias("seq"), F.col(status).alias("status")
    rows = events.select(*own, F.col(time).cast("timestamp").alias("time")).withColumn("at", F.unix_micros("time"))
    rows = rows.withWatermark("time", delay) if delay else rows.drop("time")
    life = JobLife(int(silence * 1000), delay is not None)
    return rows.groupBy("job").transformWithState(life, outputStructType=LIFE, outputMode="Update", timeMode="EventTime" if delay else "ProcessingTime")


def last_of(lives: DataFrame, jobs: Sequence[str] = ("job",)) -> DataFrame:
    """The last row of each job in what `job_lives` has written: more events, then staleness."""
    return lives.groupBy(*jobs).agg(F.max_by(F.struct("state", "started", "seen", "events", "stale"), F.struct("events", "stale")).alias("r")).select(*jobs, "r.*")
