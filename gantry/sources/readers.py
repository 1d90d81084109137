"""Readers of run folders, logs, telemetry and profiles."""

from __future__ import annotations

import json
import math
import posixpath
import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.functions import nested, strings
from gantry.sources import files
from gantry.sources import schemas as X


def document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole files as one object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """JSON lines with `malformed`, true for lines that can't be read."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    text = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_path").alias("_file"))
    rows = text.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "_file").select("r.*", "_file")
    return rows.withColumn("malformed", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def malformed_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_file").agg(F.count_if("malformed").alias("malformed_lines"), F.count_if(~F.col("malformed")).alias("lines"))


def rank_events(spark: SparkSession, path) -> DataFrame:
    """Events with the rank of their file's name (0 if it names none), unreadable lines dropped."""
    rows = lenient_lines(spark, path, X.EVENT).where(~F.col("malformed")).drop("malformed")
    named = F.regexp_extract("_file", r"rank(\d+)\.jsonl$", 1)
    return rows.withColumn("rank", F.coalesce("rank", named.try_cast("int"), F.lit(0)))


def telemetry(spark: SparkSession, path) -> DataFrame:
    """Telemetry files of either format; values that are missing or no numbers are null."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)  # files of one format
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    text = {c: (F.col(c) if c in rows.columns else F.lit(None).cast("string")) for c in X.TELEMETRY}
    flags = X.TELEMETRY[8:]
    return rows.select(
        strings.telemetry_time(text["timestamp"], F.lit(None).cast("timestamp")).alias("ts"), text["index"].try_cast("int").alias("gpu_index"),
        *(strings.maybe_number(text[c]).alias(c) for c in X.TELEMETRY[2:8]), *(strings.maybe_flag(text[c]).alias(c) for c in flags),
        F.col("_metadata.file_path").alias("_file"),
    )


def _folder(depth: int = 1):
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """One row for each folder with a status and a rendered run; others are left out."""
    status = document(spark, f"{root}/*/status.json", X.STATUS).select("*", _folder().alias("run_dir"))
    rendered = document(spark, f"{root}/*/rendered_run.json", X.RENDERED).select("job", _folder().alias("run_dir"))
    return status.join(rendered, "run_dir")


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """Statuses of attempt folders (20 hex digits) and, without an attempt, of the older flat layout."""
    flat = document(spark, f"{root}/*/status.json", X.STATUS).select("*", _folder().alias("run_dir"), F.lit(None).cast("string").alias("attempt"))
    nested = document(spark, f"{root}/*/attempts/*/status.json", X.STATUS).select("*", _folder(3).alias("run_dir"), _folder().alias("attempt"))
    return flat.unionByName(nested.where(F.col("attempt").rlike("^[0-9a-f]{20}$")))


def registry(spark: SparkSession, files: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Queue files (path: phase and record type) in one table."""
    out = None
    for path, (phase, record) in files.items():
        part = lines(spark, path, X.JOB).withColumns({"phase": F.lit(phase), "record_type": F.lit(record)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def changed_since(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of files whose time or size is not as last seen (columns path, modified, size)."""
    m = F.col("_metadata")
    marked = rows.select("*", m["file_path"].alias("path"), m["file_modification_time"].alias("modified"), m["file_size"].alias("size"))
    same = [marked["path"] == seen["path"], marked["modified"] == seen["modified"], marked["size"] == seen["size"]]
    return marked.join(seen, same, "left_anti")


def next_folders(listing: DataFrame, running: Sequence[str], phases: Sequence[str], batch: int = 8) -> DataFrame:
    """The next few folders to scan: running ones, then live, then by phase, the newest first."""
    order = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    return listing.orderBy(~F.col("job_id").isin(list(running)), ~F.col("live"), F.when(order == 0, len(phases) + 1).otherwise(order), F.col("modified").desc(), "job_id").limit(batch)


def normalised_conversations(rows: DataFrame, form: str) -> DataFrame:
    """`rows` with `messages` in place of instruction fields (form `alpaca`) or raw messages; null where a row is none.

    Contents are stripped. An instruction row needs an instruction and an output, its input goes below the instruction. Messages
    need a known role and a content each, an optional leading system message, then user and assistant in turns, in pairs.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    if form == "alpaca":
        ask, more, answer = (strip(F.col(c)) for c in ("instruction", "input", "output"))
        user = F.when(more != "", F.concat(ask, F.lit("\n\nInput:\n"), more)).otherwise(ask)
        made = F.when((ask != "") & (answer != ""), F.array(message(F.lit("user"), user), message(F.lit("assistant"), answer)))
        return rows.withColumn("messages", made)
    clean = F.transform("messages", lambda m: message(strip(m["role"]), strip(m["content"])))
    known = F.forall(clean, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))
    rest = nested.without_system(clean)
    turns = F.forall(F.transform(rest, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    return rows.withColumn("messages", F.when(known & turns & (F.size(rest) > 0) & (F.size(rest) % 2 == 0), clean))


def pools(spark: SparkSession, folder: str, specs: Mapping[str, Mapping]) -> DataFrame:
    """Source pools below `folder` as one table: source_dataset, source_index, sample_id, messages.

    `specs` maps a pool to its form, pool_size and revision. `<pool>.jsonl` holds its rows and `<pool>.json` what is known of them;
    another number of rows or another revision is an error.
    """
    out = None
    for name, spec in specs.items():
        info = document(spark, f"{folder}/{name}.json", X.POOL_INFO).first()
        if info is None or info["revision"] != spec["revision"]:
            raise ValueError(f"pool {name} has revision {info and info['revision']}, not {spec['revision']}")
        rows = normalised_conversations(lines(spark, f"{folder}/{name}.jsonl", X.POOL_ROW), spec["form"])
        part = rows.select(F.lit(name).alias("source_dataset"), "source_index", F.concat(F.lit(f"{name}:"), "source_index").alias("sample_id"), "messages")
        out = part if out is None else out.unionByName(part)
    found = {r["source_dataset"]: r["count"] for r in out.groupBy("source_dataset").count().collect()}  # one row a pool
    for name, spec in specs.items():
        if found.get(name, 0) != spec["pool_size"]:
            raise ValueError(f"pool {name} has {found.get(name, 0)} rows, not {spec['pool_size']}")
    return out


def business_records(spark: SparkSession, path) -> DataFrame:
    """Lines that are arrays of one object with exactly the keys system, prompt and response; others are marked."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = F.from_json("value", "array<map<string,string>>")
    good = (F.size(parsed) == 1) & (F.array_sort(F.map_keys(F.element_at(parsed, 1))) == F.array(F.lit("prompt"), F.lit("response"), F.lit("system")))
    return rows.select(F.coalesce(good, F.lit(False)).alias("valid"), F.when(good, F.element_at(parsed, 1)).alias("record")).select("valid", *(F.col("record")[k].alias(k) for k in ("system", "prompt", "response")))


def log_tail(spark: SparkSession, path: str, root: str, most: int = 65_536) -> DataFrame:
    """The last bytes of a log under `root`, from the first whole line on; only these are read. A path that leads out of the root is an error."""
    inside = posixpath.normpath(path)
    if not inside.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{path} is not under {root}")
    size = files.length(spark, inside) or 0
    text = files.read_range(spark, inside, max(0, size - most), most).decode("utf-8", "replace") if size else ""
    return spark.createDataFrame([(inside, text[text.find("\n") + 1 :] if size > most else text)], "path string, tail string")


def length_profiles(spark: SparkSession, path) -> DataFrame:
    """Profiles with the data set from the file's name up to its first dot."""
    return lines(spark, path, X.LENGTHS).withColumn("dataset_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))


def rank_steps(spark: SparkSession, path, schema: T.StructType, step: str = "step") -> DataFrame:
    """Timing records by rank and step; of several for one step the last in the file."""
    rows = spark.read.schema(schema).json(path).select("*", F.regexp_extract(F.col("_metadata.file_name"), r"rank(\d+)", 1).try_cast("int").alias("rank"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    w = Window.partitionBy("rank", step).orderBy(F.col("_block").desc(), F.col("_line").desc())  # ids ascend within a block alone
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_block", "_line")


def columns_of(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """A pruned Parquet scan."""
    return spark.read.parquet(path).select(*fields)


def listing_rows(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """A text listing by a pattern; lines that don't match are dropped."""
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(*(F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)))


def tensor_counts(spark: SparkSession, path: str, components: Mapping[str, str] | None = None) -> DataFrame:
    """Parameters by tensor from the headers of tensor files, which alone are read: path, tensor, kind, parameters, component.

    `components` maps a component to a pattern for the names of its tensors; the first that fits counts, else `rest`.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p in pdf["path"]:
                with files.open_uri(p) as f:
                    header = json.loads(f.read(struct.unpack("<Q", f.read(8))[0]))
                out += [(p, name, info["dtype"], math.prod(info["shape"])) for name, info in header.items() if name != "__metadata__"]
            yield pd.DataFrame(out, columns=["path", "tensor", "kind", "parameters"])

    rows = files.listed(spark, path).select("path").mapInPandas(run, "path string, tensor string, kind string, parameters long")
    component = F.coalesce(*(F.when(F.col("tensor").rlike(pattern), F.lit(name)) for name, pattern in (components or {}).items()), F.lit("rest"))
    return rows.withColumn("component", component)


def picture_size(f) -> tuple[int | None, int | None]:
    """Width and height from the header of an open PNG or JPEG file; markers are skipped by seeking."""
    head = f.read(26)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    at = 2
    while head[:2] == b"\xff\xd8":
        f.seek(at)
        part = f.read(9)
        if len(part) < 9 or part[0] != 0xFF:
            break
        if 0xC0 <= part[1] <= 0xCF and part[1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", part[5:9])
            return w, h
        at += 2 + struct.unpack(">H", part[2:4])[0]
    return None, None


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Width and height of PNG and JPEG files by their headers; null where there is none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = []
            for p in pdf["path"]:
                with files.open_uri(p) as f:
                    found.append(picture_size(f))
            yield pd.DataFrame({"path": pdf["path"], "width": pd.array([w for w, _ in found], dtype="Int32"), "height": pd.array([h for _, h in found], dtype="Int32")})

    return files.listed(spark, path).select("path").mapInPandas(run, "path string, width int, height int")


def file_digests(spark: SparkSession, root: str, block: int = 8 << 20) -> DataFrame:
    """path under the root, length and sha256 of all files below it, read in tasks a block at a time."""

    def run(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            found = []
            for uri in pdf["uri"]:
                digest = hashlib.sha256()
                with files.open_uri(uri) as f:
                    while part := f.read(block):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pdf.assign(sha256=found)[["path", "length", "sha256"]]

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("uri"), "length")
    below = len(files.qualified(spark, root).rstrip("/")) + 2
    return listed.withColumn("path", F.expr(f"substring(uri, {below})")).mapInPandas(run, "path string, length long, sha256 string")


def verified_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Manifest (path under the root, sha256) against the files: ok, mismatched or missing.

    Spark's listing leaves out empty files, so a path that it does not have is looked at by itself.
    """
    there = file_digests(spark, root).select(F.col("path").alias("_p"), F.col("sha256").alias("_sha"))
    both = manifest.select("path", "sha256").join(there, F.col("path") == F.col("_p"), "left").drop("_p")
    top = files.qualified(spark, root).rstrip("/")

    def look(batches):
        for pdf in batches:
            pdf["_sha"] = [files.EMPTY_SHA if files.is_empty(f"{top}/{p}") else None for p in pdf["path"]]
            yield pdf

    both = both.where("_sha IS NOT NULL").unionByName(both.where("_sha IS NULL").mapInPandas(look, both.schema))
    state = F.when(F.col("_sha").isNull(), "missing").when(F.col("_sha") == F.col("sha256"), "ok").otherwise("mismatched")
    return both.select("path", state.alias("state"))
