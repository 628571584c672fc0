"""Comparing a query's rows with its SQL on DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(map(value, v))
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer)) or isinstance(v, (float, np.floating)) and float(v).is_integer():
            return int(v)
        return round(float(v), 9) if isinstance(v, (float, np.floating)) else v

    return sorted((tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)
