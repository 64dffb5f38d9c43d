"""Compare a query's rows with those of its SQL in DuckDB."""

import glob
import os

import pandas as pd


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(value):
    if isinstance(value, float):
        return "null" if value != value else f"{value:.6g}"
    if isinstance(value, (bool, int, str)):
        return str(value)
    if hasattr(value, "__len__"):
        return "[" + ",".join(map(shown, value)) + "]"
    if value is None or pd.isna(value):
        return "null"
    return shown(value.item()) if hasattr(value, "item") else str(value)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(shown, r)) for r in df.astype(object).itertuples(index=False, name=None))
