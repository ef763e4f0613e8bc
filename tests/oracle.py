"""Side-by-side comparison of a Spark result with DuckDB SQL."""

import datetime
import glob

import duckdb
import pandas as pd


def oracle(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(v))
    if isinstance(v, (bool, str)):
        return v
    try:
        return float(v)
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(repr(tuple(cell(v) for v in r)) for r in df.itertuples(index=False, name=None))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
