"""Runs every query and its SQL on the same tables and compares the rows without regard to order."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value + 0.0:.6f}"
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, key: str, sf_dir: str) -> str:
    """Empty text when both sides agree, otherwise what differs."""
    df = contract.queries()[key](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(contract.oracle_sql()[key])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}"
    want = _rows(columns, cursor.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows <> {sum(want.values())}; only here {list(got - want)[:3]}; only there {list(want - got)[:3]}"


def main(sf_dir: str, keys: list[str]) -> None:
    from tablero.session import local_session

    spark, con = local_session(), connection(sf_dir)
    for key in keys or list(contract.queries()):
        started = time.time()
        try:
            result = compare(spark, con, key, sf_dir)
        except Exception as error:  # report and go on with the next key
            result = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{key:24} {time.time() - started:6.2f}s {'ok' if not result else 'DIFF ' + result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
