"""Compare queries with their SQL in DuckDB: rows as multisets, columns by name."""

from __future__ import annotations

import datetime
import glob
import math
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.13g}"))
    if isinstance(v, int):
        return float(v) if abs(v) < 1 << 53 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if not isinstance(v, (str, bytes)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def differences(df, con, sql: str) -> str:
    """Empty if both agree."""
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want, want_columns = rows_of(want_columns, cur.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} and {want_columns}"
    if got == want:
        return ""
    a = [x for x in got if x not in set(want)][:2]
    b = [x for x in want if x not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only here {a}; only there {b}"
