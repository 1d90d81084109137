"""Queries that run streams: tables are landed as files in several goes, read by streams that stop and start again, and what was written is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.plans.base import query
from gantry.plans.files import _folder
from gantry.sources import files
from gantry.streaming import buckets, ledger, lifecycle, tail


def _drain(stream: DataFrame, folder: str, write, mode: str = "append") -> None:
    """Run a stream over all that is there, from its checkpoint under `folder`."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _into(path: str):
    """A `foreachBatch` that writes each batch once."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number:06d}")


_LINE = "concat('{\"event_id\":', event_id, ',\"user_id\":', user_id, '}')"


@query(f"""WITH e AS (SELECT *, event_id % 3 AS f, {_LINE} AS line, max(event_id) OVER () // 2 AS cut FROM events),
o AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY f, f = 2 AND event_id > cut ORDER BY event_id) - strlen(line) AS BIGINT) AS pos FROM e),
k AS (SELECT *, f = 2 AND event_id <= cut AND event_id = max(CASE WHEN event_id <= cut THEN event_id END) OVER (PARTITION BY f) AS lost FROM o)
SELECT concat('rank', f, '.jsonl') AS name, pos AS "offset", event_id, user_id FROM k WHERE NOT lost""")
def source_tail(t):
    """Files that grow: at first half of the events, the last of them without its line end, then the rest. The third file is
    rotated in between, so that the end of its half line never comes."""
    folder, half = _folder(t), t.events.agg(F.floor(F.max("event_id") / 2).alias("cut"), F.max("event_id").alias("top"))
    rows = t.events.join(F.broadcast(half)).withColumn("f", F.col("event_id") % 3)  # one row
    # each line begins with the end of the one before, and its own last sign parts the rows of the file
    value = F.concat(F.lit("\n"), F.expr(f"rtrim('}}', {_LINE})"))
    rows = rows.select(F.concat(F.lit("rank"), F.col("f"), F.lit(".jsonl")).alias("name"), "event_id", value.alias("value"), "cut", "f")
    last = rows.groupBy("name").agg((F.max("event_id") + 1).alias("event_id")).withColumn("value", F.lit("\n"))
    for landed in (rows.where("event_id <= cut"), rows.where("f < 2 OR event_id > cut").select(*last.columns).unionByName(last)):
        files.write_named(landed, f"{folder}/logs", "event_id", line_end="}")
        _drain(tail.tail_lines(t.spark, f"{folder}/logs", "*.jsonl", split_bytes=64 << 10), folder, _into(f"{folder}/lines"))
    read = t.spark.read.parquet(f"{folder}/lines").withColumn("e", F.from_json("line", "event_id long, user_id long"))
    return read.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "offset", "e.*")


_STATE = "CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' END"


def _landed_events(t, folder: str, part, parts: int):
    """Land events in `parts` goes, rows of part k in the k-th, and yield after each."""
    rows = t.events.withColumn("part", part)
    for k in range(parts):
        rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{folder}/events")
        yield k


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job, event_id, ts, {_STATE} AS s FROM events),
b AS (SELECT job, max(ts) AS started FROM e WHERE s = 'running' GROUP BY job),
k AS (SELECT e.*, b.started, row_number() OVER (PARTITION BY e.job ORDER BY e.ts, e.event_id) AS i, max(CASE WHEN s = 'running' THEN event_id END) OVER (PARTITION BY e.job, e.ts) AS tie FROM e LEFT JOIN b USING (job)),
f AS (SELECT *, started IS NULL OR ts > started OR (ts = started AND event_id >= tie) AS live FROM k)
SELECT job, coalesce(arg_min(CASE WHEN live AND s IN ('failed', 'success') THEN s END, CASE WHEN live AND s IN ('failed', 'success') THEN i END), arg_max(s, CASE WHEN s IS NOT NULL THEN i END), 'planned') AS state,
epoch_us(any_value(started)) AS started, epoch_us(max(ts)) AS seen, count(*) AS events FROM f GROUP BY job""")
def job_lives(t):
    """Job states kept as state over shuffled batches with a restart between any two."""
    folder, spark = _folder(t), t.spark
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", max(4, spark.sparkContext.defaultParallelism))  # state keeps the number it began with
    try:
        for _ in _landed_events(t, folder, F.pmod(F.xxhash64("event_id"), F.lit(3)), 3):
            rows = spark.readStream.schema(t.events.schema).parquet(f"{folder}/events").withColumn("s", F.expr(_STATE))
            _drain(lifecycle.job_lives(rows, "user_id", "s", "ts", "event_id", silence=3600, delay="60 days"), folder, _into(f"{folder}/lives"), "update")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    return lifecycle.last_of(spark.read.parquet(f"{folder}/lives").drop("batch")).select("job", "state", "started", "seen", "events")


@query("""WITH p AS (SELECT least(event_id // 2500, 3) AS batch, count(*) AS n FROM events GROUP BY 1),
l AS (SELECT batch, n AS rows, CASE WHEN batch = 2 THEN 'ValueError: batch 2 is broken' END AS error, sum(CASE WHEN batch <> 2 THEN 1 ELSE 0 END) OVER (ORDER BY batch) AS revision FROM p)
SELECT CAST(batch AS BIGINT) AS batch, rows, error, CAST(revision AS BIGINT) AS revision FROM l""")
def batch_ledger(t):
    """Polling goes on behind a batch that fails; its error stands in the ledger."""
    folder = _folder(t)

    def apply(batch: DataFrame, number: int) -> None:
        if number == 2:
            raise ValueError("batch 2 is broken")
        _into(f"{folder}/rows")(batch, number)

    for _ in _landed_events(t, folder, F.least(F.floor(F.col("event_id") / 2500), F.lit(3)), 4):
        _drain(t.spark.readStream.schema(t.events.schema).parquet(f"{folder}/events"), folder, ledger.kept(apply, f"{folder}/ledger"))
    return ledger.ledger(t.spark, f"{folder}/ledger").where("rows > 0").select("batch", "rows", "error", "revision")


@query("""WITH l AS (SELECT event_id, ts, sum(CASE WHEN event_id % 7 <> 3 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS revision, lead(ts) OVER (ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'error'),
b AS (SELECT *, unnest(range(0, CAST(1 + greatest(floor((epoch_us(coalesce(nxt, ts)) - epoch_us(ts) - CASE WHEN nxt IS NULL THEN 0 ELSE 1 END) / 3600000000), 0) AS BIGINT))) AS k FROM l)
SELECT CASE WHEN k > 0 THEN 'heartbeat' WHEN event_id % 7 = 3 THEN 'error' ELSE 'revision' END AS kind, CAST(revision AS BIGINT) AS revision, ts + to_microseconds(k * 3600000000) AS told FROM b""")
def change_notices(t):
    """What a listener hears of a ledger: revisions, errors, and a heartbeat for every silent hour."""
    rows = t.events.where("event_type = 'error'").select(F.col("event_id").alias("batch"), F.lit(1).cast("long").alias("rows"), F.when(F.col("event_id") % 7 == 3, "broken").alias("error"), F.col("ts").cast("timestamp").alias("finished"))
    folder = _folder(t)
    rows.withColumn("n", F.col("batch").bitwiseAND(7)).write.partitionBy("n").parquet(folder)
    return ledger.notices(ledger.ledger(t.spark, folder), beat=3600.0).select("kind", "revision", F.col("at").cast("timestamp_ntz").alias("told"))


@query("""WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT user_id, count(*) AS kinds, max(event_id) AS newest, round(sum(value), 2) AS total FROM l GROUP BY user_id""")
def bucketed_upserts(t):
    """The newest event of each user and kind, and sums of these by user, kept in buckets of which a batch rewrites its own."""
    folder, schema = _folder(t), t.events.schema
    derive = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("kinds"), F.max("event_id").alias("newest"), F.sum("value").alias("total"))
    table = buckets.BucketedTable(t.spark, f"{folder}/table", ["user_id", "event_type"], ["event_id"], buckets=16, by=["user_id"], derive=derive)
    for _ in _landed_events(t, folder, F.pmod(F.xxhash64("event_id"), F.lit(3)), 3):
        _drain(t.spark.readStream.schema(schema).parquet(f"{folder}/events"), folder, table.upsert)
    return table.derived("user_id long, kinds long, newest long, total double").withColumn("total", F.round("total", 2))
