"""Runs a query and its SQL side by side."""

import os

import duckdb
import pandas as pd


def sql(text: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in os.listdir(folder):
        p = f"{folder}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con.execute(text).fetchdf()


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x != x:
            return "~"
        return (str(int(x)) if x == int(x) else repr(round(x, 9))) if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


def same(spark, query, text: str, folder: str) -> None:
    got, want = query(spark, folder).toPandas(), sql(text, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
