"""Run a registered query and its DuckDB twin and compare rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return value
    return value


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between both results: column names, value kinds, rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs_raw = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    order = sorted(names)
    rows = df.select(*order).collect()
    at = [names.index(n) for n in order]
    kinds = []
    for i, n in enumerate(order):
        a = {_kind(r[i]) for r in rows} - {"NoneType"}
        b = {_kind(r[at[i]]) for r in theirs_raw} - {"NoneType"}
        if a != b and a and b:
            kinds.append(f"{n}: {a} vs {b}")
    ours = Counter(tuple(_plain(v) for v in r) for r in rows)
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in theirs_raw)
    found = kinds
    if ours != theirs:
        found.append(
            f"{sum(ours.values())} vs {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]};"
            f" only theirs {list((theirs - ours).items())[:3]}; columns {order}"
        )
    return found
