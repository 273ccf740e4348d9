"""Run queries next to their SQL on DuckDB and compare all values.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is not None, str(v)) for v in row))


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    ours = sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    if name not in ORACLE:
        return f"rows only: {len(ours)}"
    cursor = connection.execute(ORACLE[name])
    names = [column[0] for column in cursor.description]
    theirs = sorted_rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"DIFFERENT COLUMNS {sorted(df.columns)} {sorted(names)}"
    if len(ours) != len(theirs):
        return f"DIFFERENT COUNTS {len(ours)} {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"DIFFERENT VALUES {len(wrong)}: {str(wrong[0])[:600]}" if wrong else f"equal: {len(ours)}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection = local_session(), connect(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            result = compare(spark, connection, sf_dir, name)
        except Exception as error:
            result = f"ERROR {str(error)[:1500]}"
        print(f"{name:24s} {time.time() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    main()
