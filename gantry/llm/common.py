"""What the corpus operators share: Arrow plumbing, chunking and vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.session import materialise, shared_dir

__all__ = [
    "BATCH_BYTES", "CHUNK_BYTES", "add_columns", "byte_chunks", "materialise", "mix64", "packed", "resident", "shared_dir", "text_batches", "unpacked", "whole_groups", "word_hashes",
]

#: Bytes of text that a task holds unpacked at a time, and that are vectorised at a time, where arrays take eight bytes a byte. One text is never cut.
BATCH_BYTES, CHUNK_BYTES = 1 << 22, 1 << 18

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (multiply and shift)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


#: A 64-bit value for each byte; LOWER gives A-Z the values of a-z.
BYTE_VALUES = mix64((np.arange(1, 257, dtype=np.uint64)) * _U(_ODD))
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
#: The white space that separates words: \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(buffer: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums of the polynomial hash: `span_hash` gets the hash of any span from them."""
    up, _ = powers(len(buffer))
    out = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(values[buffer] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end), the same wherever the span stands."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _U(_ODD))


def byte_chunks(texts: list[bytes], sep: bytes = b"\n", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole texts: (first, last, buffer, start, length); `sep` stands before every text and at the end."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield _chunk(texts, first, i, sep)
            first, size = i, 0
        size += len(t) + len(sep)
    if first < len(texts):
        yield _chunk(texts, first, len(texts), sep)


def _chunk(texts: list[bytes], first: int, last: int, sep: bytes):
    part = texts[first:last]
    buffer = np.frombuffer(sep + sep.join(part) + sep, dtype=np.uint8)
    length = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
    start = np.cumsum(length + len(sep)) - length
    return first, last, buffer, start, length


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, a maximal run without white space."""
    inside = ~IS_SPACE[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(inside) and inside[-1]:
        edge = np.concatenate([edge, [len(inside)]])
    return edge[0::2], edge[1::2]


def word_hashes(buffer: np.ndarray, start: np.ndarray, values: np.ndarray = LOWER_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z as a-z) and the number of the text it stands in; texts begin at `start`."""
    s, e = word_spans(buffer)
    return span_hash(prefix_hash(buffer, values), s, e), np.searchsorted(start, s, side="right") - 1


_resident: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], object]):
    """The one large model that a worker process keeps from task to task; asking for another one lets it go."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Hand freed memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], *names: str, limit: int = BATCH_BYTES, keeps: Hashable = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes in the named columns, one row at least; `keeps` is the resident model to keep."""
    if keeps not in _resident:
        _resident.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for name in names:
            size += pc.binary_length(batch.column(batch.schema.get_field_index(name))).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    release()


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows sorted by `keys` in tables that end where a group ends. A group is held whole: its size must be bounded by construction."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        if len(ends):
            cut = int(ends[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
    release()


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], text: str, keep: Callable | None = None) -> DataFrame:
    """`df` with more columns, made with Arrow from batches that are small in the column `text`.

    `make()` runs once a task and returns the function from a batch to the new arrays; columns of the same names
    are replaced. `keep(batch, arrays)` may give a mask of rows to keep; then the new columns are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f.name for f in fields]
    base = df.drop(*(n for n in names if n != text)) if keep is None else df
    kinds = [to_arrow_type(f.dataType) for f in fields]
    stay = [c for c in base.columns if keep is not None or c not in names]
    schema = T.StructType([*(base.schema[c] for c in stay), *fields]) if keep is None else base.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in text_batches(batches, text):
            new = f(batch)
            if keep is not None:
                yield batch.filter(pa.array(keep(batch, new), type=pa.bool_()))
                continue
            arrays = [a if isinstance(a, pa.Array) and a.type == k else pa.array(a, type=k) for a, k in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in stay), *arrays], names=[*stay, *names])

    return base.mapInArrow(run, schema)


def packed(df: DataFrame, **own: Column | str) -> DataFrame:
    """All columns of `df` as one struct `row`, beside an operator's own columns: no names can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *((F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in own.items()))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The struct's `columns` again, those in `new` replaced or added."""
    return df.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in columns), *(v.alias(n) for n, v in new.items() if n not in columns))
