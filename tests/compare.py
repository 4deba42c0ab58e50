"""Rows of a query and of its SQL, levelled for comparison."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def views(sf=SF):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def level(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return str(v) if isinstance(v, (bool, str)) or not isinstance(v, (int, float)) else repr(float(v))

    cols = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False))
