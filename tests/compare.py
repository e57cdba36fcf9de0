"""Runs queries beside their SQL and prints what differs: python tests/compare.py FOLDER [NAME...]"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, (int, float)) or hasattr(v, "__index__") else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    a, b = tidy(spark_rows), tidy(sql_rows)
    if len(a) != len(b):
        both = a.merge(b, how="outer", indicator=True)
        return f"rows {len(a)} and {len(b)}\n{both[both['_merge'] != 'both'].head(6)}"
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        return f"{bad.sum()} rows differ\n{a[bad].head(5)}\n{b[bad].head(5)}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from citeloom.session import build_session

    spark = build_session(**{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    con, sql = views(folder), entry.oracle_sql()
    for name in names:
        began = time.time()
        try:
            rows = entry.queries()[name](spark, folder).toPandas()
            took = time.time() - began
            if name in sql:
                said = differences(rows, con.execute(sql[name]).df())
            else:
                said = "no SQL"
        except Exception as e:
            rows, took, said = [], time.time() - began, f"ERROR {str(e)[:1500]}"
        print(f"{name}: {len(rows)} rows, {took:.1f} s: {said or 'same'}", flush=True)
