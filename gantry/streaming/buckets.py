"""A table that streams upsert into: rows lie in buckets by key, and a batch rewrites only the buckets that it touches.

`manifest/<batch>` maps each bucket to the version that holds it; a version is the batch that wrote it. A batch reads the
buckets of its own keys, one version each, so what it reads does not grow with the number of batches before. The manifest is
written last and renamed into place: a batch that dies leaves the table as it was and is run again from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.operators.relational import last_wins
from gantry.sources import files


class BucketedTable:
    """Rows of which the newest of each key counts.

    `by` are the columns that decide the bucket (the keys unless given). `derive` maps the rows of whole buckets to a derived
    table, which is kept in the same buckets; its groups must not cross buckets, so it needs `by` among its group columns.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64, by: Sequence[str] | None = None, derive: Callable[[DataFrame], DataFrame] | None = None, keep: int = 2):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), list(order)
        self.buckets, self.by, self.derive, self.keep = buckets, list(by or keys), derive, keep

    def manifest(self, before: int | None = None) -> dict[str, int]:
        """Bucket to version after the last batch, or the last one before a number."""
        numbers = [n for n in self._manifests() if before is None or n < before]
        if not numbers:
            return {}
        path = f"{self.path}/manifest/{max(numbers):012d}"
        return json.loads(files.read_range(self.spark, path, 0, files.length(self.spark, path)))

    def _manifests(self) -> list[int]:
        return [int(n) for n in files.names(self.spark, f"{self.path}/manifest") if n.isdigit()]

    def _paths(self, table: str, manifest: dict[str, int]) -> list[str]:
        return [f"{self.path}/{table}/version={v:012d}/bucket={b}" for b, v in manifest.items()]

    def _read(self, table: str, manifest: dict[str, int], schema) -> DataFrame:
        paths = [p for p in self._paths(table, manifest) if files.names(self.spark, p)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, table: str, number: int) -> None:
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/version={number:012d}")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """The `foreachBatch`: merge a batch into the buckets of its keys."""
        bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")
        touched = sorted(str(r[0]) for r in batch.select(bucket.alias("b")).distinct().collect())  # at most `buckets`
        known = self.manifest(before=number)
        if touched:
            old = self._read("rows", {b: known[b] for b in touched if b in known}, batch.schema)
            merged = last_wins(old.unionByName(batch), self.keys, self.order)
            self._write(merged.withColumn("bucket", bucket), "rows", number)
            now = known | dict.fromkeys(touched, number)
            if self.derive is not None:
                fresh = self._read("rows", {b: number for b in touched}, batch.schema)
                self._write(self.derive(fresh).withColumn("bucket", bucket), "derived", number)
        else:
            now = known
        files.write_bytes(self.spark, f"{self.path}/manifest/{number:012d}", json.dumps(now, sort_keys=True).encode())
        self._clean(number)

    def _clean(self, number: int) -> None:
        """Delete versions and manifests that no kept manifest names."""
        numbers = sorted(n for n in self._manifests() if n <= number)
        used = {v for n in numbers[-self.keep :] for v in self.manifest(before=n + 1).values()}
        for n in numbers[: -self.keep]:
            files.delete(self.spark, f"{self.path}/manifest/{n:012d}")
        for table in ("rows", "derived"):
            for name in files.names(self.spark, f"{self.path}/{table}"):
                version = name.removeprefix("version=")
                if version.isdigit() and int(version) <= number and int(version) not in used:
                    files.delete(self.spark, f"{self.path}/{table}/{name}")

    def rows(self, schema) -> DataFrame:
        return self._read("rows", self.manifest(), schema)

    def derived(self, schema) -> DataFrame:
        return self._read("derived", self.manifest(), schema)
