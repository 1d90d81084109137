"""Session defaults, the folder that driver and executors share, and the tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def build_session(app: str = "gantry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; other settings by keyword (dots as `__`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Where it is unset, a temporary one on one machine and an error on a cluster."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gantry-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


#: Rows that go to a Python worker at a time while a table is written: whole texts fill a batch of the usual size with far more than they need.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    name, most = ARROW_ROWS
    usual = int(spark.conf.get(name))
    spark.conf.set(name, min(usual, most) if usual > 0 else most)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(name, usual)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Folders of the tables that `materialise` has written and `discard` has not deleted."""
    return list(_written.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of `materialise` once nothing that is still to run reads them."""
    known = _written.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in paths if p in known]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        known.remove(path)


def let_go(spark: SparkSession) -> None:
    """Have the driver's garbage collected, so that Spark's cleaner deletes the shuffle files of plans that are done.

    Executors keep these files until then; between large steps whose results are written tables they are of no more use.
    """
    spark._jvm.java.lang.System.gc()
