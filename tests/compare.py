"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


FAMILIES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def difference(df, con, sql: str) -> str | None:
    """None if both results agree in columns, types and rows; else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()], strict=True))
    rows = con.execute(sql).fetchall()
    columns = sorted(names)
    if sorted(df.columns) != columns:
        return f"columns {sorted(df.columns)} != {columns}"
    ours_types = dict(df.dtypes)
    for c in columns:
        if FAMILIES.get(ours_types[c]) != types[c]:
            return f"type of {c}: {ours_types[c]} != {types[c]}"
    place = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in place) for r in rows)
    ours = Counter(tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if ours != theirs:
        a, b = list((ours - theirs).items())[:2], list((theirs - ours).items())[:2]
        return f"rows {sum(ours.values())} vs {sum(theirs.values())}; only Spark {a}; only SQL {b}"
    return None
