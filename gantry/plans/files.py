"""Queries over sources and sinks: tables are landed as files in the shared folder and read again."""

from __future__ import annotations

import json
import struct
import uuid

from pyspark.sql import functions as F

from gantry.plans.base import query
from gantry.session import shared_dir
from gantry.sources import files, readers, schemas, sinks
from gantry.streaming import incremental as I


def _folder(t) -> str:
    """A folder of the application's own, deleted when it ends."""
    path = f"{shared_dir(t.spark)}/landed-{uuid.uuid4().hex}"
    files.delete_at_exit(t.spark, path)
    return path


def _landed(t, rows, order: str = "n") -> str:
    """Text files from rows (name, n, value)."""
    folder = _folder(t)
    files.write_named(rows, folder, order)
    return folder


def _lines(rows, name, order, /, **fields):
    """Rows (name, n, value) with an object of `fields` as JSON."""
    return rows.select(name.alias("name"), order.alias("n"), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("value"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def source_documents(t):
    """Objects over several lines, one a file."""
    key = F.col("r_regionkey")
    parts = F.array(F.lit("{"), F.concat(F.lit('  "id": '), key.cast("string"), F.lit(",")), F.concat(F.lit('  "name": "'), F.col("r_name"), F.lit('"')), F.lit("}"))
    rows = t.region.select(F.concat(F.lit("r"), key.cast("string"), F.lit(".json")).alias("name"), F.posexplode(parts).alias("n", "value"))
    return readers.document(t.spark, f"{_landed(t, rows)}/*.json", schemas._struct(id=schemas._L, name=schemas._S))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def source_lines(t):
    rows = _lines(t.nation, F.lit("queue.jsonl"), F.col("n_nationkey").cast("double"), id=F.col("n_nationkey"), name=F.col("n_name"))
    blank = t.nation.select(F.lit("queue.jsonl").alias("name"), (F.col("n_nationkey") + 0.5).alias("n"), F.lit("").alias("value"))
    return readers.lines(t.spark, _landed(t, rows.unionByName(blank)), schemas._struct(id=schemas._L, name=schemas._S))


@query("""SELECT user_id % 4 AS part, count_if(event_id % 10 = 0) AS malformed_lines, count_if(event_id % 10 <> 0) AS lines FROM events GROUP BY 1""")
def source_lenient_lines(t):
    rows = _lines(t.events, F.concat(F.lit("part"), (F.col("user_id") % 4).cast("string"), F.lit(".jsonl")), F.col("event_id"), event=F.col("event_type"), global_step=F.col("event_id"))
    rows = rows.withColumn("value", F.when(F.col("n") % 10 == 0, F.concat(F.lit("{broken "), F.col("value"))).otherwise(F.col("value")))
    out = readers.malformed_counts(readers.lenient_lines(t.spark, _landed(t, rows), schemas.EVENT))
    return out.select(F.regexp_extract("_file", r"part(\d)", 1).cast("long").alias("part"), "malformed_lines", "lines")


@query("""SELECT CAST(user_id % 4 AS INTEGER) AS rank, event_type AS event, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY ALL""")
def source_rank_events(t):
    rows = _lines(t.events, F.concat(F.lit("events.rank"), (F.col("user_id") % 4).cast("string"), F.lit(".jsonl")), F.col("event_id"), event=F.col("event_type"))
    rows = rows.withColumn("value", F.when(F.col("n") % 10 == 0, "{broken").otherwise(F.col("value")))
    return readers.rank_events(t.spark, _landed(t, rows)).groupBy("rank", "event").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(user_id % 8 AS INTEGER) AS gpu_index, CASE WHEN event_type <> 'error' THEN round(value, 2) END AS power, CASE WHEN user_id % 2 = 1 AND event_type = 'view' THEN 1 WHEN user_id % 2 = 1 AND event_type = 'click' THEN 0 END AS thermal_limit FROM events""")
def source_telemetry(t):
    """Files of the older format and of the extended one."""
    watts = F.when(F.col("event_type") == "error", "[N/A]").otherwise(F.format_string("%.2f", "value"))
    flag = F.when(F.col("event_type") == "view", "Active").when(F.col("event_type") == "click", "Not Active").otherwise("[N/A]")
    base = [F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS"), (F.col("user_id") % 8).cast("string"), F.col("event_id").cast("string"), F.lit("90"), watts, F.lit("1400")]
    out = None
    for odd, more, head in ((0, [], ""), (1, [F.lit("40"), F.lit("N/A"), flag], ", temperature, fan, thermal_limit")):
        rows = t.events.where(F.col("user_id") % 2 == odd).select(F.lit(f"gpu{odd}.csv").alias("name"), F.col("event_id").alias("n"), F.concat_ws(", ", *base, *more).alias("value"))
        first = t.spark.range(1).select(F.lit(f"gpu{odd}.csv").alias("name"), F.lit(-1).cast("long").alias("n"), F.lit(f"timestamp, index, memory, utilization, power, clock{head}").alias("value"))
        part = readers.telemetry(t.spark, _landed(t, first.unionByName(rows)))
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("memory").cast("long").alias("event_id"), "gpu_index", "power", "thermal_limit")


def _runs(t):
    key = F.col("n_nationkey")
    run = F.concat(F.lit("run"), key.cast("string"))
    status = _lines(t.nation, F.concat(run, F.lit("/status.json")), key, classification=F.when(key % 2 == 0, "success").otherwise("oom"), started_unix=key.cast("double"))
    rendered = t.nation.where("n_nationkey % 3 > 0").select(F.concat(run, F.lit("/rendered_run.json")).alias("name"), key.alias("n"), F.to_json(F.struct(F.struct(F.concat(F.lit("job"), key.cast("string")).alias("job_id")).alias("job"), F.array(F.lit("x")).alias("command"))).alias("value"))
    return status, rendered, run


@query("""SELECT concat('run', n_nationkey) AS run_dir, concat('job', n_nationkey) AS job_id, CASE WHEN n_nationkey % 2 = 0 THEN 'success' ELSE 'oom' END AS classification FROM nation WHERE n_nationkey % 3 > 0""")
def source_runs(t):
    status, rendered, _ = _runs(t)
    return readers.runs(t.spark, _landed(t, status.unionByName(rendered))).select("run_dir", F.col("job.job_id").alias("job_id"), "classification")


@query("""SELECT concat('run', n_nationkey) AS run_dir, CAST(NULL AS VARCHAR) AS attempt FROM nation UNION ALL SELECT concat('run', n_nationkey), substr(sha256(CAST(n_nationkey AS VARCHAR)), 1, 20) FROM nation WHERE n_nationkey % 2 = 0""")
def source_attempts(t):
    """Attempt folders and the flat layout; a folder that is no attempt's (a view of the latest) is left out."""
    status, _, run = _runs(t)
    key = F.col("n_nationkey")
    named = lambda part: t.nation.where("n_nationkey % 2 = 0").select(F.concat(run, F.lit("/attempts/"), part, F.lit("/status.json")).alias("name"), key.alias("n"), F.lit('{"classification":"success"}').alias("value"))
    rows = status.unionByName(named(F.substring(F.sha2(key.cast("string"), 256), 1, 20))).unionByName(named(F.lit("latest")))
    return readers.attempts(t.spark, _landed(t, rows)).select("run_dir", "attempt")


@query("SELECT concat('n', n_nationkey, '.jsonl') AS name FROM nation WHERE n_nationkey % 4 = 0")
def source_changed_files(t):
    """Files whose size is not as last seen."""
    key = F.col("n_nationkey")
    path = _landed(t, _lines(t.nation, F.concat(F.lit("n"), key.cast("string"), F.lit(".jsonl")), key, id=key))
    rows = t.spark.read.schema("id long").json(path)
    m = F.col("_metadata")
    seen = rows.select(m["file_path"].alias("path"), m["file_modification_time"].alias("modified"), (m["file_size"] + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("size"))
    return readers.changed_since(rows, seen).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


@query("""SELECT s_suppkey AS job_id FROM supplier ORDER BY s_suppkey NOT IN (7, 9), s_suppkey % 5 > 0, CASE s_nationkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, s_acctbal DESC, s_suppkey LIMIT 8""")
def source_next_folders(t):
    phase = F.element_at(F.array(F.lit("other"), F.lit("memory"), F.lit("throughput")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    listing = t.supplier.select(F.col("s_suppkey").alias("job_id"), (F.col("s_suppkey") % 5 == 0).alias("live"), phase.alias("phase"), F.col("s_acctbal").alias("modified"))
    return readers.next_folders(listing, [7, 9], ["memory", "throughput"]).select("job_id")


@query("""SELECT concat('j', c_custkey) AS job_id, CASE WHEN c_custkey % 2 = 0 THEN 'memory' ELSE 'throughput' END AS phase, CASE WHEN c_custkey % 2 = 0 THEN 'family' ELSE 'job' END AS record_type FROM customer""")
def source_registry(t):
    rows = _lines(t.customer, F.when(F.col("c_custkey") % 2 == 0, "memory.jsonl").otherwise("throughput.jsonl"), F.col("c_custkey"), job_id=F.concat(F.lit("j"), F.col("c_custkey").cast("string")))
    folder = _landed(t, rows)
    return readers.registry(t.spark, {f"{folder}/memory.jsonl": ("memory", "family"), f"{folder}/throughput.jsonl": ("throughput", "job")}).select("job_id", "phase", "record_type")


@query("""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'asked' ELSE 'talks' END AS source_dataset, concat(CASE WHEN c_custkey % 2 = 0 THEN 'asked:' ELSE 'talks:' END, c_custkey) AS sample_id,
CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN concat('user=ask ', c_name, CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Input:' || chr(10) || 'more' ELSE '' END, '|assistant=said')
WHEN c_custkey % 5 = 0 THEN concat('system=be brief|user=', c_name, '|assistant=said') WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('user=', c_name, '|assistant=said') END AS talk FROM customer""")
def source_conversations(t):
    """Two pools, one of instructions and one of messages; rows without an answer and those out of turn are none."""
    key, name = F.col("c_custkey"), F.col("c_name")
    answer = F.when(key % 7 == 0, " ").otherwise(" said ")
    asked = _lines(t.customer.where("c_custkey % 2 = 0"), F.lit("asked.jsonl"), key, source_index=key, instruction=F.concat(F.lit(" ask "), name), input=F.when(key % 3 == 0, "more").otherwise(" "), output=answer)
    said = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    brief = F.when(key % 5 == 0, F.array(said(F.lit("system"), F.lit("be brief")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    turns = F.concat(brief, F.array(said(F.when((key % 11 == 0) & (key % 5 != 0), "assistant").otherwise("user"), name), said(F.lit("assistant"), answer)))
    talks = _lines(t.customer.where("c_custkey % 2 = 1"), F.lit("talks.jsonl"), key, source_index=key, messages=turns)
    infos = t.customer.groupBy(F.when(key % 2 == 0, "asked").otherwise("talks").alias("id")).agg(F.count("*").alias("n"))
    infos = infos.select(F.concat("id", F.lit(".json")).alias("name"), "n", F.to_json(F.struct("id", F.lit("r1").alias("revision"), F.col("n").alias("pool_rows"))).alias("value"))
    folder = _landed(t, asked.unionByName(talks).unionByName(infos))
    sizes = {p: {"form": form, "pool_size": n, "revision": "r1"} for p, form, n in (("asked", "alpaca", t.customer.where("c_custkey % 2 = 0").count()), ("talks", "messages", t.customer.where("c_custkey % 2 = 1").count()))}
    rows = readers.pools(t.spark, folder, sizes)
    return rows.select("source_dataset", "sample_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("talk"))


@query("""SELECT c_custkey % 3 = 0 AS valid, count(*) AS n FROM customer GROUP BY 1""")
def source_business_records(t):
    key, text = F.col("c_custkey"), F.col("c_name")
    one = F.struct(F.lit("s").alias("system"), text.alias("prompt"), F.lit("r").alias("response"))
    value = F.when(key % 3 == 0, F.to_json(F.array(one))).when(key % 3 == 1, F.to_json(F.array(one, one))).otherwise(F.to_json(F.array(F.struct(text.alias("prompt"), F.lit("r").alias("response")))))
    rows = t.customer.select(F.lit("b.jsonl").alias("name"), key.alias("n"), value.alias("value"))
    return readers.business_records(t.spark, _landed(t, rows)).groupBy("valid").agg(F.count("*").alias("n"))


@query("""SELECT string_agg(concat('line ', n_nationkey, chr(10)), '' ORDER BY n_nationkey) AS tail FROM nation WHERE n_nationkey >= 16""")
def source_log_tail(t):
    rows = t.nation.select(F.lit("train.log").alias("name"), F.col("n_nationkey").alias("n"), F.concat(F.lit("line "), F.col("n_nationkey").cast("string")).alias("value"))
    folder = _landed(t, rows)
    return readers.log_tail(t.spark, f"{folder}/train.log", folder, 75).select("tail")


@query("""SELECT concat('set', s_nationkey % 3) AS dataset_id, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS tokens FROM supplier GROUP BY 1""")
def source_length_profiles(t):
    rows = _lines(t.supplier, F.concat(F.lit("set"), (F.col("s_nationkey") % 3).cast("string"), F.lit(".nothink.jsonl")), F.col("s_suppkey"), sample_id=F.col("s_name"), total_tokens=F.col("s_suppkey"))
    return readers.length_profiles(t.spark, _landed(t, rows)).groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))


@query("""SELECT CAST(s_suppkey % 2 AS INTEGER) AS rank, s_suppkey // 4 AS step, max(s_suppkey) AS seconds FROM supplier GROUP BY ALL""")
def source_rank_steps(t):
    """Of several records of a step the last in the file."""
    rows = _lines(t.supplier, F.concat(F.lit("clean_timing_rank"), (F.col("s_suppkey") % 2).cast("string"), F.lit(".jsonl")), F.col("s_suppkey"), step=F.floor(F.col("s_suppkey") / 4), seconds=F.col("s_suppkey"))
    return readers.rank_steps(t.spark, _landed(t, rows), schemas._struct(step=schemas._L, seconds=schemas._L)).select("rank", "step", "seconds")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def source_columns(t):
    return readers.columns_of(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS revision FROM nation WHERE n_nationkey % 5 > 0")
def source_listing(t):
    key = F.col("n_nationkey")
    rows = t.nation.select(F.lit("listing.txt").alias("name"), key.alias("n"), F.when(key % 5 == 0, "total 0").otherwise(F.concat(F.lit("-rw "), F.col("n_name"), F.lit(" r"), key.cast("string"))).alias("value"))
    return readers.listing_rows(t.spark, _landed(t, rows), r"^-rw (.+) r(\d+)$", ["name", "revision"])


@query("""SELECT 'vision' AS component, 24 AS parameters UNION ALL SELECT 'rest', 110""")
def source_tensor_counts(t):
    """Headers of two tensor files whose data would be far longer than what is there."""
    folder = _folder(t)
    for k, tensors in enumerate(({"visual.w": [2, 3, 4], "model.e": [10, 5]}, {"model.h": [6, 10]})):
        header = json.dumps({"__metadata__": {"format": "pt"}} | {n: {"dtype": "BF16", "shape": s, "data_offsets": [0, 1 << 40]} for n, s in tensors.items()}).encode()
        files.write_bytes(t.spark, f"{folder}/{k}.safetensors", struct.pack("<Q", len(header)) + header)
    return readers.tensor_counts(t.spark, folder, {"vision": r"^visual\."}).groupBy("component").agg(F.sum("parameters").alias("parameters"))


@query("""SELECT 'a.png' AS name, 640 AS width, 480 AS height UNION ALL SELECT 'b.jpg', 70000 % 65536, 33 UNION ALL SELECT 'c.txt', NULL, NULL""")
def source_image_sizes(t):
    folder = _folder(t)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x02\x00\x00\x00"
    jpeg = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 33, 70000 % 65536) + b"\0" * 9
    for name, content in (("a.png", png), ("b.jpg", jpeg), ("c.txt", b"no picture, but long enough to be one")):
        files.write_bytes(t.spark, f"{folder}/{name}", content)
    return readers.image_sizes(t.spark, folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "width", "height")


@query("""SELECT concat('r', r_regionkey) AS path, CASE WHEN r_regionkey = 4 THEN 'missing' WHEN r_regionkey % 2 = 1 THEN 'mismatched' ELSE 'ok' END AS state FROM region""")
def source_manifest(t):
    key = F.col("r_regionkey")
    rows = t.region.where("r_regionkey < 4").select(F.concat(F.lit("r"), key.cast("string")).alias("name"), key.alias("n"), F.col("r_name").alias("value"))
    manifest = t.region.select(F.concat(F.lit("r"), key.cast("string")).alias("path"), F.sha2(F.concat(F.col("r_name"), F.lit("\n"), F.when(key % 2 == 1, "x").otherwise("")), 256).alias("sha256"))
    return readers.verified_files(t.spark, _landed(t, rows), manifest)


@query("""SELECT '{"a":' || n_nationkey || ',"b":{"c":' || CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE '"' || n_name || '"' END || ',"z":1}}' AS line FROM nation""")
def sink_lines(t):
    """Keys in order at every depth, nulls kept."""
    path = _folder(t)
    sinks.write_lines(t.nation.select(F.struct(F.lit(1).alias("z"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).alias("c")).alias("b"), F.col("n_nationkey").alias("a")), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT n_nationkey, '["' || n_name || '",null]' AS names FROM nation""")
def sink_parquet(t):
    path = _folder(t)
    sinks.write_parquet(t.nation.select("n_nationkey", F.array("n_name", F.lit(None).cast("string")).alias("names")), path, nested_as_text=True)
    return t.spark.read.parquet(path)


@query("SELECT r_regionkey, r_name FROM region")
def sink_json(t):
    path = _folder(t)
    sinks.write_json(t.region.select("r_regionkey", "r_name"), path)
    return t.spark.read.schema("r_regionkey long, r_name string").json(path)


@query("""SELECT 0 AS n, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '|-|-|' UNION ALL SELECT 2 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region""")
def sink_markdown(t):
    page = sinks.markdown(t.region.select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return t.spark.createDataFrame(list(enumerate(page.split("\n"))), "n long, line string")


@query("""SELECT count(DISTINCT o_orderstatus) AS campaigns, count_if(o_orderkey % 1000 = 0) AS failing, CASE WHEN count_if(o_orderkey % 1000 = 0) > 0 THEN 'error' ELSE 'stale' END AS state, max(o_orderkey) AS latest FROM orders""")
def campaign_health(t):
    state = F.when(F.col("o_orderkey") % 1000 == 0, "error").when(F.col("o_orderkey") % 3 == 0, "stale").otherwise("ok")
    return I.merged_health(t.orders.select("o_orderstatus", state.alias("s"), "o_orderkey"), "o_orderstatus", "s", "o_orderkey")
