"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    base = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return base


def _plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat(" ")
    return "null" if value is None else str(value)


def _kind(name: str) -> str:
    name = name.upper()
    for kind, words in {
        "int64": ("BIGINT", "LONG", "HUGEINT", "INT64"),
        "int32": ("INT",),
        "double": ("DOUBLE", "DECIMAL"),
        "text": ("STRING", "VARCHAR"),
        "time": ("TIMESTAMP",),
        "date": ("DATE",),
    }.items():
        if name.startswith(words):
            return kind
    return name


def differences(result: DataFrame, base: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when schema and rows agree."""
    expected = base.sql(sql)
    wanted = dict(zip(expected.columns, [_kind(str(t)) for t in expected.types]))
    found = {field.name: _kind(field.dataType.simpleString()) for field in result.schema}
    problems = [f"{n}: spark {found.get(n)} sql {wanted.get(n)}" for n in sorted({*found, *wanted}) if found.get(n) != wanted.get(n)]
    if {*found} != {*wanted}:
        return problems
    order = sorted(found)
    left = sorted(tuple(_plain(row[name]) for name in order) for row in result.collect())
    positions = [expected.columns.index(name) for name in order]
    right = sorted(tuple(_plain(row[i]) for i in positions) for row in expected.fetchall())
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)} sql {len(right)}")
    unlike = [(a, b) for a, b in zip(left, right) if a != b]
    if unlike:
        problems.append(f"{len(unlike)} unlike rows, first spark {unlike[0][0]} sql {unlike[0][1]} ({order})")
    return problems
