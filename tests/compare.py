"""Side-by-side check of a query and its SQL: same rows in any order, same column names, same values."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TESTDATA = os.environ.get("FOOTFALL_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "0.0" if value == 0 else repr(value)
    return str(value)


def kind(value) -> str:
    return type(value).__name__


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((kind(r[i]), normal(r[i])) for i in order) for r in rows)


def differences(columns, rows, oracle_columns, oracle_rows, show: int = 3) -> str | None:
    if sorted(columns) != sorted(oracle_columns):
        return f"columns {sorted(columns)} != {sorted(oracle_columns)}"
    ours, theirs = bag(columns, rows), bag(oracle_columns, oracle_rows)
    if ours == theirs:
        return None
    return (
        f"rows {sum(ours.values())} / {sum(theirs.values())}; only here {sum((ours - theirs).values())}: "
        f"{list((ours - theirs))[:show]}; only there: {list((theirs - ours))[:show]}"
    )
