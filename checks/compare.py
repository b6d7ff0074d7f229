"""Compare every query with its SQL: ``python -m checks.compare [sf] [query ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from .fixtures import TABLES
from .oracles import ORACLES
from .queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


KINDS = {
    "bigint": "int64", "int": "int32", "double": "double", "string": "text", "boolean": "bool", "timestamp_ntz": "timestamp",
    "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "text", "BOOLEAN": "bool", "TIMESTAMP": "timestamp",
}


def difference(spark, db, sf_dir: str, name: str, queries: dict = QUERIES, oracles: dict = ORACLES) -> str | None:
    """None if rows, column names, types and values agree, else what differs."""
    got = queries[name](spark, sf_dir)
    if name not in oracles:
        return None if got.count() else "no rows"
    want = db.sql(oracles[name])
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} against {sorted(want.columns)}"
    kinds = {c: KINDS.get(t, t) for c, t in got.dtypes}
    wanted = {c: KINDS.get(str(t), str(t)) for c, t in zip(want.columns, want.types)}
    if kinds != wanted:
        return f"types {[(c, kinds[c], wanted[c]) for c in columns if kinds[c] != wanted[c]]}"
    places = [want.columns.index(c) for c in columns]
    a = sorted([tuple(map(repr, (row[c] for c in columns))) for row in got.collect()])
    b = sorted([tuple(map(repr, (row[i] for i in places))) for row in want.fetchall()])
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"row {x} against {y} in {columns}"
    return None if a else "both sides are empty"


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    db, bad = connect(sf_dir), 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            found = difference(spark, db, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:700]}"
        bad += found is not None
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'ok  ' if found is None else 'DIFF'} {name}{kind} {time.time() - start:.2f}s {found or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
