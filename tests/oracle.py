"""Compare a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NA:
            return None
        return round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x

    found = [tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(([float(x) if isinstance(x, (int, bool)) else x for x in r] for r in found), key=repr)
