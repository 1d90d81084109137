"""Streams: byte-offset tails, job states with timers, ledgers, bucketed upserts; stops and starts in between."""

from __future__ import annotations

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from gantry.streaming import buckets, ledger, lifecycle, tail
from gantry.streaming import incremental as inc


def drain(stream, folder, write, mode="append"):
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_every_cut_gives_each_line_once(monkeypatch):
    monkeypatch.setattr(tail, "_BLOCK", 7)
    r = random.Random(1)
    for _ in range(1000):
        data = bytes(r.choice(b"ab\n\n") for _ in range(r.randrange(60)))
        f, got, want, at = io.BytesIO(data), [], [], 0
        cuts = sorted({0, len(data), *(r.randrange(len(data) + 1) for _ in range(4))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            if not a or tail._ends_within(f, a, b):
                got += tail.whole_lines(f, a, b)
        for line in data.splitlines(keepends=True):
            want += [(at, line)] if line.endswith(b"\n") else []
            at += len(line)
        assert got == want


def test_files_that_grow_are_cut_and_rotated(spark, tmp_path):
    logs, seen = tmp_path / "logs", []
    logs.mkdir()

    def poll(content: bytes | None = None, name: str = "a.log"):
        if content is not None:
            (logs / name).write_bytes(content)
        found = []
        # a stream of its own each time: what it knows is in the checkpoint
        drain(tail.tail_lines(spark, str(logs), "*.log", split_bytes=4), tmp_path, lambda b, _: found.extend(b.select("path", "offset", "line").collect()))
        seen.extend(found)
        return sorted((os.path.basename(r["path"]), r["offset"], r["line"]) for r in found)

    assert poll(b"one\n\ntw") == [("a.log", 0, "one")]
    assert poll() == []
    assert poll(b"one\n\ntwo\nthree\n") == [("a.log", 5, "two"), ("a.log", 9, "three")]
    assert poll(b"x\n") == [("a.log", 0, "x")]  # cut short
    assert poll(b"new\nrotated and longer\nhalf") == [("a.log", 0, "new"), ("a.log", 4, "rotated and longer")]  # another file in its place
    assert poll(b"caf\xc3\xa9 \xff\n", "b.log") == [("b.log", 0, "café \N{REPLACEMENT CHARACTER}")]
    (logs / "b.log").unlink()
    assert poll(b"new\nrotated and longer\nhalf a line\n") == [("a.log", 23, "half a line")]
    assert poll(b"ignored\n", "c.txt") == [] and len(seen) == 8


def test_offsets_tell_growth_from_rotation():
    at = lambda content: {"at": len(content), "marks": tail.marks(content[:1024])}
    assert tail.begin_of(None, at(b"abc")) == 0 and tail.begin_of(at(b""), at(b"abc")) == 0
    assert tail.begin_of(at(b"abc"), at(b"abcd")) == 3 == tail.begin_of(at(b"abc"), at(b"abc"))
    assert tail.begin_of(at(b"abcd"), at(b"abc")) == 0 and tail.begin_of(at(b"abc"), at(b"xbcd")) == 0
    long = bytes(range(256)) * 8
    assert tail.begin_of(at(long), at(long + b"x")) == len(long) and tail.begin_of(at(long[:1000]), at(long[:512] + b"?" + long)) == 1000  # beyond the last whole mark a change can't be told
    assert tail.begin_of(at(long), at(b"?" + long)) == 0


#: Events at the epoch itself would be late from the start.
BASE = 1_700_000_000
STATUS = ["running", "success", "failed", "oom", "planned", None]


def test_job_states_equal_the_batch_query(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"j{r.randrange(6)}", r.randrange(40), i, r.choice(STATUS)) for i in range(300)]
    df = spark.createDataFrame(rows, "job string, sec int, seq long, status string").withColumn("ts", F.timestamp_seconds(F.col("sec") + BASE))
    r.shuffle(rows)
    for k in range(3):
        df.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        drain(lifecycle.job_lives(stream, "job", "status", "ts", "seq", delay="1 day"), tmp_path, lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), "update")
    got = {x["job"]: (x["state"], x["events"]) for x in lifecycle.last_of(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {x["job"]: (x["state"], x["events"]) for x in inc.latest_states(df, "job", "status", "ts", "seq").collect()}


def test_silent_jobs_become_stale(spark, tmp_path):
    schema = "job string, sec int, seq long, status string"
    goes = [[("a", 0, 1, "running"), ("b", 0, 1, "running"), ("c", 0, 1, "running")], [("b", 5, 2, None), ("c", 6, 2, "success"), ("d", 30, 1, "planned")], [("b", 8, 3, None), ("d", 31, 2, None)], [("a", 40, 2, None)]]
    for rows in goes:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("sec") + BASE)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        drain(lifecycle.job_lives(stream, "job", "status", "ts", "seq", silence=10, delay="1 second"), tmp_path, lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), "update")
    out = [(x["job"], x["seen"] // 1_000_000 - BASE, x["stale"]) for x in spark.read.parquet(f"{tmp_path}/out").orderBy("batch", "job", "stale").collect()]
    assert [x for x in out if x[2]] == [("a", 0, True), ("b", 5, True)]  # c has ended and d was never started
    assert ("a", 40, False) in out and ("d", 31, False) in out


def test_a_failing_batch_is_kept_and_the_next_runs(spark, tmp_path):
    done, times = [], iter(range(100, 200, 10))

    def apply(batch, number):
        values = [x["id"] for x in batch.collect()]
        if 3 in values:
            raise ValueError("three\nand more")
        done.extend(values)

    for k in range(5):
        spark.range(k, k + 1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), tmp_path, ledger.kept(apply, f"{tmp_path}/ledger", lambda: next(times)))
    rows = ledger.ledger(spark, f"{tmp_path}/ledger").orderBy("batch").collect()
    assert done == [0, 1, 2, 4] and [(x["batch"], x["rows"], x["error"], x["revision"]) for x in rows] == [(0, 1, None, 1), (1, 1, None, 2), (2, 1, None, 3), (3, 1, "ValueError: three", 3), (4, 1, None, 4)]
    again = ledger.kept(lambda b, n: None, f"{tmp_path}/ledger", lambda: 130.0)
    again(spark.range(2), 3)  # a batch that is run again replaces its row
    assert [(x["rows"], x["revision"]) for x in ledger.ledger(spark, f"{tmp_path}/ledger").orderBy("batch").collect()] == [(1, 1), (1, 2), (1, 3), (2, 4), (1, 5)]


def test_notices_beat_in_silence(spark):
    stamp = lambda s: F.timestamp_seconds(F.lit(s))
    rows = spark.createDataFrame([(1, 1, None, 0, 1), (2, 0, None, 5, 1), (3, 1, "E", 31, 1), (4, 1, None, 61, 2)], "batch long, rows long, error string, s long, revision long")
    told = ledger.notices(rows.withColumn("finished", F.timestamp_seconds("s")), until="1970-01-01 00:01:40", beat=15.0)
    assert [(x["kind"], x["revision"], x["s"]) for x in told.select("kind", "revision", F.unix_seconds("at").alias("s")).orderBy("at").collect()] == [
        ("revision", 1, 0), ("heartbeat", 1, 15), ("heartbeat", 1, 30), ("error", 1, 31), ("heartbeat", 1, 46), ("revision", 2, 61), ("heartbeat", 2, 76), ("heartbeat", 2, 91),
    ]
    assert told.limit(0).select(stamp(0)).count() == 0


@pytest.fixture
def table(spark, tmp_path):
    derive = lambda rows: rows.groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    return buckets.BucketedTable(spark, f"{tmp_path}/t", ["k", "i"], ["at"], buckets=8, by=["k"], derive=derive)


SCHEMA = "k string, i long, v long, at long"


def test_upserts_read_only_their_buckets(spark, table, monkeypatch):
    r, known, read = random.Random(3), {}, []
    whole = table._read
    monkeypatch.setattr(table, "_read", lambda name, manifest, schema: read.append((name, len(manifest))) or whole(name, manifest, schema))
    for number in range(6):
        rows = [(f"k{r.randrange(20) if number == 0 else number}", r.randrange(5), r.randrange(100), number * 100 + j) for j in range(40 if number == 0 else 3)]
        known |= {(k, i): (v, at) for k, i, v, at in rows}
        read.clear()
        table.upsert(spark.createDataFrame(rows, SCHEMA), number)
        assert number == 0 or read == [("rows", 1), ("rows", 1)]  # one bucket was touched, whatever came before
    assert {(x["k"], x["i"]): (x["v"], x["at"]) for x in table.rows(SCHEMA).collect()} == known
    totals = {}
    for (k, _), (v, _) in known.items():
        t, n = totals.get(k, (0, 0))
        totals[k] = t + v, n + 1
    assert {x["k"]: (x["total"], x["n"]) for x in table.derived("k string, total long, n long").collect()} == totals
    assert len(buckets.files.names(spark, f"{table.path}/manifest")) == 2  # older versions that nothing names are gone
    assert len(buckets.files.names(spark, f"{table.path}/rows")) <= 6


def test_a_batch_that_died_is_run_again(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1)], SCHEMA), 0)

    def die(*_):
        raise OSError("lost")

    monkeypatch.setattr(buckets.files, "write_bytes", die)
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([("a", 1, 7, 2)], SCHEMA), 1)
    monkeypatch.undo()
    values = lambda: {(x["k"], x["v"]) for x in table.rows(SCHEMA).collect()}
    assert values() == {("a", 1), ("b", 1)}
    for _ in range(2):
        table.upsert(spark.createDataFrame([("a", 1, 7, 2)], SCHEMA), 1)
        assert values() == {("a", 7), ("b", 1)}
    table.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert values() == {("a", 7), ("b", 1)}


def test_a_job_is_one_value_of_state():
    """Each state of a key costs calls to the store for every key of a batch."""
    kept = []

    class Handle:
        def getValueState(self, name, schema):
            kept.append(name)

        getListState = getValueState

    lifecycle.JobLife(1, True).init(Handle())
    assert kept == ["life"]
