"""Single files of whatever store Spark reads: small ranges and small files on the driver, headers in tasks."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def length(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file; none where there is no file."""
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getLen() if fs.exists(p) and fs.getFileStatus(p).isFile() else None


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's listings name it."""
    fs, p = _at(spark, path)
    return fs.makeQualified(p).toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_range(spark: SparkSession, path: str, offset: int, most: int) -> bytes:
    """At most `most` bytes from `offset` on; nothing before is read."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        stream.seek(offset)
        size = max(0, min(most, fs.getFileStatus(p).getLen() - offset))
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, written beside and then renamed."""
    fs, p = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} could not be put in place")


def write_named(rows: DataFrame, folder: str, order: str, line_end: str = "\n") -> None:
    """One text file under `folder` for each `name` of rows (name, value), lines in order; a name's lines are one task's."""
    spark, beside = rows.sparkSession, f"{folder}.parts"
    rows.repartition("name").sortWithinPartitions("name", order).select("name", "value").write.partitionBy("name").option("lineSep", line_end).text(beside)
    fs, top = _at(spark, beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        if not name.startswith("name="):
            continue
        (part,) = [s.getPath() for s in fs.listStatus(status.getPath()) if s.getPath().getName().startswith("part-")]
        target = path(f"{folder}/{unquote(name[5:])}")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        fs.rename(part, target)
    fs.delete(top, True)


def store_of(uri: str):
    """pyarrow's file system of a path as Spark names it, unescaped, and the path in it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if uri.startswith("/") or scheme == "file":
        return fs.LocalFileSystem(), uri if uri.startswith("/") else "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(uri, safe=":/@?=&"))


def open_uri(uri: str):
    """A seekable file in a task, by pyarrow's file systems."""
    store, path = store_of(uri)
    return store.open_input_file(path)


#: SHA-256 of no bytes.
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def is_empty(uri: str) -> bool:
    """Whether there is a file without content, seen from a task."""
    from pyarrow import fs

    store, path = store_of(uri)
    info = store.get_file_info(path)
    return info.type == fs.FileType.File and info.size == 0


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Mark a folder to be deleted when the application ends."""
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path and length of files, without their contents."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("length"))
