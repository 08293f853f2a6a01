"""Run registered queries in Spark and DuckDB and compare rows.  usage: python -m checks.compare [SF_DIR] [KEY ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import all_sql
from checks.queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def duck(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def compare(spark: SparkSession, connection, sf_dir: str, key: str) -> str | None:
    """None if equal, else what differs."""
    df = all_queries()[key](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(all_sql()[key])
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    types = {d[0]: str(d[1]) for d in result.description}
    spark_types = dict(df.dtypes)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP"}
    for column, kind in spark_types.items():
        if column in types and types[column] != kinds.get(kind):
            return f"type of {column}: {kind} / {types[column]}"
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1], strict=True):
        if a != b:
            return f"{a}\n    {b}"
    return None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(all_queries())
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    base = duck(folder)
    bad = 0
    for name in keys:
        began = time.time()
        try:
            problem = compare(session, base, folder, name) if name in all_sql() else "no SQL"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} equal")
