"""Writers. Spark commits a folder at once, so readers never see half of one."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(value, path: str) -> None:
    """A small report of the driver: written beside and then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(temporary, path)


def _in_order(column, kind: T.DataType):
    """A column with the keys of its structs in order, at every depth."""
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_in_order(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _in_order(x, kind.elementType))
    return column


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines without spaces, keys in order at every depth, nulls kept."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    df.select(*(_in_order(F.col(c), kinds[c]).alias(c) for c in sorted(df.columns))).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def encoded(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name) for f in df.schema.fields))


def write_parquet(df: DataFrame, path: str, partition: Sequence[str] = (), nested_as_text: bool = False) -> None:
    out = encoded(df) if nested_as_text else df
    out.write.mode("overwrite").partitionBy(*partition).parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table; more rows than `most` are an error, as it is a page for people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a page")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
