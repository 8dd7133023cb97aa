"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def database(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def value(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float | np.floating) and math.isnan(v)) or v is pd.NA:
        return "~"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float | np.floating | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(map(value, v)) + "]"
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted("|".join(map(value, r)) for r in frame.itertuples(index=False, name=None))
