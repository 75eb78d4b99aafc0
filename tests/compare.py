"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

Usage: python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def spark_session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = normal(got), normal(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if str(a.dtype) != str(b.dtype) and not (len(a) == 0 or a.isna().any() or b.isna().any()):
            return f"type of {c}: {a.dtype} != {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}: {(~same).sum()} of {len(a)} differ, first {a[i]!r} != {b[i]!r}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = spark_session(os.environ.get("BENCH_CPUS", "8")), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracle:
                print(f"{name:32s} rows-only {len(got)} rows {took:.1f}s", flush=True)
                continue
            issue = difference(got, con.execute(oracle[name]).df())
        except Exception as error:  # noqa: BLE001
            issue, got, took = f"{type(error).__name__}: {str(error)[:600]}", [], time.time() - start
        bad += issue is not None
        print(f"{name:32s} {'ok' if issue is None else 'DIFF ' + issue} {len(got)} rows {took:.1f}s", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
