"""Runs a query and its SQL over the same Parquet tables and compares the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


def rows_of(df) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())


def rows_of_sql(c, sql: str, columns: list[str]) -> Counter:
    names = ",".join(f'"{x}"' for x in sorted(columns))
    return Counter(tuple(map(plain, r)) for r in c.execute(f"select {names} from ({sql})").fetchall())
