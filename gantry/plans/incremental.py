"""Queries over the incremental operators, on whole tables (their streams are tested against these)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.plans.base import query
from gantry.streaming import incremental as I


@query("""SELECT event_id, user_id, ts FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id) AS s FROM events) WHERE s IS NULL OR ts >= s""")
def attempt_fencing(t):
    return I.fenced(t.events, "user_id", "ts", F.col("event_type") == "signup").select("event_id", "user_id", "ts")


@query("""WITH f AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id) AS s FROM events) SELECT user_id, count(*) AS kept, max(event_id) AS current_step FROM f WHERE s IS NULL OR ts >= s GROUP BY user_id""")
def reset_samples(t):
    """Samples of earlier attempts are deleted and the current step is recomputed from what stays."""
    rows = I.fenced(t.events, "user_id", "ts", F.col("event_type") == "signup")
    return rows.groupBy("user_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("current_step"))


@query("""WITH RECURSIVE o AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 'planned' AS state FROM events UNION ALL SELECT w.user_id, o.i, CASE WHEN o.s IS NOT NULL AND (w.state NOT IN ('success', 'failed', 'oom') OR o.s = 'running') THEN o.s ELSE w.state END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, arg_max(state, i) AS state, max(i) AS events FROM w GROUP BY user_id""")
def job_states(t):
    rows = t.events.withColumn("s", F.expr("CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' END"))
    return I.latest_states(rows, "user_id", "s", "ts", "event_id")


@query("""SELECT sha256(concat(user_id, ':', event_type)) AS event_key, count(*) AS n FROM events GROUP BY 1""")
def replay_keys(t):
    rows = I.keyed(t.events, F.col("user_id"), F.col("event_type"))
    return rows.groupBy("event_key").agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT props) AS kept, count(*) AS read FROM events""")
def idempotent_replay(t):
    rows = I.keyed(t.events, F.col("props"))
    return rows.agg(F.count("*").alias("read")).join(F.broadcast(I.once(rows).agg(F.count("*").alias("kept"))))


@query("""SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 256""")
def cold_start(t):
    return I.cold_start(t.events, ["ts", "event_id"]).select("event_id")


@query("""SELECT event_id, 1706745600 - epoch_us(ts) / 1e6 <= 86400 AND event_type = 'click' AS live FROM events""")
def liveness(t):
    rows = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("s", F.when(F.col("event_type") == "click", "running").otherwise("done"))
    return I.live(rows, "at", "s", F.lit(1706745600), 86400).select("event_id", "live")


@query("""SELECT 'a' AS campaign_id, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'b', count(*) FROM events WHERE event_type = 'view'""")
def campaign_fan_in(t):
    return I.fan_in({"a": t.events.where("event_type = 'click'"), "b": t.events.where("event_type = 'view'")}).groupBy("campaign_id").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT user_id FROM events WHERE event_id >= 9000) SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE user_id IN (SELECT user_id FROM d) GROUP BY user_id""")
def dirty_keys(t):
    dirty = t.events.where("event_id >= 9000").select("user_id").distinct()
    return t.events.join(dirty, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
