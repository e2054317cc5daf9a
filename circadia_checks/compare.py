"""Run a query on Spark and its SQL on DuckDB, and say where the two differ."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    """A private in-memory connection with one view per parquet file."""
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def _kind(value) -> str:
    return {bool: "bool", int: "int", float: "float"}.get(type(value), type(value).__name__)


def difference(spark: SparkSession, run, sql: str, folder: str) -> str | None:
    """None when names, rows and value types agree, else a short report."""
    df = run(spark, folder)
    names = sorted(df.columns)
    ours = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    cursor = duck(folder).execute(sql)
    header = [d[0] for d in cursor.description]
    if sorted(header) != names:
        return f"columns {names} against {sorted(header)}"
    at = [header.index(n) for n in names]
    theirs = [tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()]
    a, b = Counter(ours), Counter(theirs)
    if a != b:
        return f"{len(ours)} rows against {len(theirs)}; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
    for i, name in enumerate(names):
        kinds = [{_kind(r[i]) for r in rows if r[i] is not None} for rows in (ours, theirs)]
        if kinds[0] != kinds[1]:
            return f"{name}: {kinds[0]} against {kinds[1]}"
    return None
