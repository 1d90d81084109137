"""Growing text files as a stream: a byte offset for each file, whole lines only, read in tasks.

The driver lists files and looks at their first bytes; it reads no lines. A batch is a byte range of each file, and a line
belongs to the range that its line end stands in: the task of that range looks back for where the line began. So a half line
waits until its end is written, and a long range is read by many tasks without agreeing on where lines begin.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gantry.sources.files import open_uri, store_of

#: A file is known by digests of its first 1, 2, 4, ... bytes, as many as it has.
MARKS = 11
_BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file whose line ends stand in [begin, end)."""

    path: str
    begin: int
    end: int

    def __post_init__(self):
        super().__init__(None)


def marks(head: bytes) -> str:
    """Digests by which a longer file of the same beginning is known again."""
    return ",".join(hashlib.sha256(head[: 1 << k]).hexdigest()[:8] for k in range(MARKS) if len(head) >= 1 << k)


def begin_of(before: dict | None, now: dict) -> int:
    """Where reading goes on: at the offset if the file only grew, else, as it was cut or rotated, at its beginning."""
    if before is None or now["at"] < before["at"] or not f"{now['marks']},".startswith(f"{before['marks']}," if before["marks"] else ""):
        return 0
    return before["at"]


def whole_lines(f, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) of the lines of an open file whose ends stand in [begin, end)."""
    at, left = begin, b""
    while at and not left:  # look back for the end of the line before
        size = min(_BLOCK, at)
        f.seek(at - size)
        cut = f.read(size).rfind(b"\n")
        at -= size
        if cut >= 0:
            at, left = at + cut + 1, b"\n"
    f.seek(at)
    pos, held = at, []
    while pos < end:
        block = f.read(min(_BLOCK, end - pos))
        if not block:
            return
        pos += len(block)
        parts = block.split(b"\n")
        for part in parts[:-1]:
            line = b"".join([*held, part, b"\n"])
            yield at, line
            at, held = at + len(line), []
        held.append(parts[-1])


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.pattern, self.split = options["path"], options.get("pattern", "*"), int(options.get("splitBytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, folder = store_of(self.folder)
        found = {}
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            name = info.path[len(folder) :].lstrip("/")
            if info.type == fs.FileType.File and fnmatch.fnmatch(name, self.pattern):
                with store.open_input_file(info.path) as f:
                    found[name] = {"at": info.size, "marks": marks(f.read(min(info.size, 1 << (MARKS - 1))))}
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, now in end.items():
            begin = begin_of(start.get(name), now)
            out += [Range(f"{self.folder.rstrip('/')}/{name}", at, min(at + self.split, now["at"])) for at in range(begin, now["at"], self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        offsets, lines, size = [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())], names=["path", "offset", "line"])
        with open_uri(partition.path) as f:
            if partition.begin and not _ends_within(f, partition.begin, partition.end):
                return  # the middle of a line is not looked back from
            for at, line in whole_lines(f, partition.begin, partition.end):
                text = line.decode("utf-8", "replace").strip()
                if text:
                    offsets.append(at)
                    lines.append(text)
                    size += len(line)
                if size > 4 << 20:
                    yield batch()
                    offsets, lines, size = [], [], 0
        yield batch()


def _ends_within(f, begin: int, end: int) -> bool:
    f.seek(begin)
    while begin < end:
        block = f.read(min(_BLOCK, end - begin))
        if not block or b"\n" in block:
            return bool(block)
        begin += len(block)
    return False


class LineTail(DataSource):
    """Format `line_tail`: path, offset and line of files below the folder `path` whose names fit `pattern`; blank lines are left out."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def tail_lines(spark: SparkSession, folder: str, pattern: str = "*", split_bytes: int = 64 << 20) -> DataFrame:
    """A stream of the whole lines that files below `folder` get; its checkpoint holds an offset and digests for each file.

    A file that got shorter or begins otherwise was cut or rotated and is read from its beginning; a file that is gone is forgotten.
    """
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("pattern", pattern).option("splitBytes", split_bytes).load(folder)
