"""Order-free comparison of a DataFrame with what DuckDB gives for SQL on the same tables."""

import datetime

import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def text(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return "null"
    if isinstance(x, (list, tuple, np.ndarray)):
        return f"[{','.join(map(text, x))}]"
    if isinstance(x, (float, np.floating)):
        return "null" if x != x else str(int(x)) if float(x).is_integer() else repr(float(x))
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(x))
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False, name=None))
