"""Run registered queries against their SQL: python tests/compare.py <folder> [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)
    clean = (
        tuple(None if v is None else float(v) if isinstance(v, (int, float)) else str(v) for v in r)
        for r in rows
    )
    return sorted(clean, key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides give the same columns and rows."""
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    from suite.queries import ORACLE, QUERIES

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names or QUERIES:
        started = time.time()
        try:
            if name in ORACLE:
                df = QUERIES[name](spark, folder)
                result = difference(df, con, ORACLE[name]) or "ok"
            else:
                result = f"rows only: {QUERIES[name](spark, folder).count()}"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - started:6.1f}s {result}", flush=True)


if __name__ == "__main__":
    main()
