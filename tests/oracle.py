"""Compares a query with its SQL in DuckDB as sorted rows."""

import math
import os

import duckdb
import pandas as pd


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "~"
    if "bool" in type(x).__name__:
        return str(bool(x))
    if "float" in type(x).__name__:
        x = round(float(x), 6)
        return str(int(x)) if x == int(x) else str(x)
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = [frame[c].tolist() for c in sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in zip(*columns))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as from '{sf_dir}/{f}'")
    return con
