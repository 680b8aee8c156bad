"""One small local session, and the comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
from pyspark.sql import DataFrame, SparkSession

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def session(checkpoints: str, warehouse: str) -> SparkSession:
    conf = {
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": checkpoints, "spark.sql.warehouse.dir": warehouse, "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set enable_progress_bar = false")
    con.execute("set timezone = 'UTC'")
    for file in sorted(os.listdir(sf_dir)):
        name, kind = os.path.splitext(file)
        if kind == ".parquet":
            con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{file}')")
    return con


def plain(value):
    """A value both engines agree on: numbers to 9 significant digits, containers as tuples."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float | decimal.Decimal):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0  # no negative zero
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def ordered(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def agree(df: DataFrame, sql: str, sf_dir: str) -> int:
    """The number of rows, after both sides have been found equal."""
    done = views(sf_dir).execute(sql)
    names = [c[0] for c in done.description]
    assert sorted(names) == sorted(df.columns)
    mine, theirs = ordered(df.columns, df.collect()), ordered(names, done.fetchall())
    assert len(mine) == len(theirs)
    odd = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not odd, odd[:3]
    return len(mine)
