"""Compares a query's rows to its SQL's, whatever their order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace(" 00:00:00", "")


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(shown(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def sql_rows(sql: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return rows(con.execute(sql).df().astype(object))


def spark_rows(df) -> list[tuple]:
    return rows(df.toPandas().astype(object))
