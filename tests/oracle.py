"""Run a query and its SQL twin on the same tables and compare their rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

from tessera.sources.tables import NAMES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in NAMES:
        at = Path(sf_dir, f"{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    got = df.collect()
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    mine, theirs = rows(df.columns, got), rows(rel.columns, rel.fetchall())
    if mine == theirs:
        kinds = {c: t for c, t in df.dtypes}
        whole = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT"}
        odd = [c for c, t in zip(rel.columns, map(str, rel.types), strict=True) if (kinds[c] in ("int", "bigint", "smallint")) != (t in whole)]
        return f"types of {odd}" if odd else ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
