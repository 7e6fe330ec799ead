"""Runs a query's SQL in DuckDB and compares values, whatever the order of rows."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple, np.ndarray)) else str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, x)) for x in frame[columns].astype(object).itertuples(index=False)), key=repr)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def assert_same(df, sf_dir, sql):
    mine, theirs = df.toPandas(), duck(sf_dir, sql)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)
