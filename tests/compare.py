"""Spark rows against DuckDB rows of the same query."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(value):
    """A value without the types that only one of the two engines uses."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(map(plain, value))
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def kinds(df) -> dict[str, str]:
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE"}
    return {n: names.get(t, t) for n, t in df.dtypes}


def differences(df, con, sql: str) -> str:
    """What differs, or nothing."""
    cur = con.execute(sql)
    names, types = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: only here {[r for r in got if r not in set(want)][:2]}, only there {[r for r in want if r not in set(got)][:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} and {b}"
    own = kinds(df)
    return "; ".join(f"type of {n}: {own[n]} and {t}" for n, t in zip(names, types) if own[n] != t and "[" not in t and "STRUCT" not in t)
