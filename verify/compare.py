"""Run registered queries against their SQL: ``python -m verify.compare <sf dir> [prefix ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from souqlytics.session import build_session
from verify.oracle import ORACLE
from verify.queries import QUERIES
from verify.standin import DRIVER_TABLES

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(pdf: pd.DataFrame, names: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return v

    rows = [tuple(plain(v) for v in row) for row in pdf[names].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", "") for v in r))


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when names, types and all rows are the same, else what differs."""
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    other = result.fetchall()
    ours = dict(df.dtypes)
    if set(ours) != set(theirs):
        return f"columns: {sorted(set(ours) ^ set(theirs))}"
    for name, kind in ours.items():
        if TYPES.get(kind, kind) != theirs[name]:
            return f"type of {name}: {kind} / {theirs[name]}"
    names = sorted(ours)
    order = list(theirs)
    a = rows_of(pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object), names)
    b = rows_of(pd.DataFrame(other, columns=order, dtype=object), names)
    if len(a) != len(b):
        return f"rows: {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
            return f"values: {str(bad)[:300]} in {str(x)[:200]}"
    return None


def main(sf_dir: str, prefixes: list[str], spark: SparkSession | None = None) -> int:
    spark = spark or build_session(
        "compare", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLE:
                verdict = compare(df, con, ORACLE[name])
            else:
                verdict = None
                df.count()
        except Exception as e:  # noqa: BLE001 - the report goes on with the next query
            verdict = f"{type(e).__name__}: {str(e)[:400]}"
        failed += verdict is not None
        state = "ok" if verdict is None and name in ORACLE else "rows only" if verdict is None else "DIFF"
        print(f"{state:9} {name} {time.time() - start:.1f}s {(verdict or '')}".replace("\n", " "), flush=True)
    print(f"{failed} differences")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
