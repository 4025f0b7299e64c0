"""Spark results held against DuckDB's, as sorted rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(f"{sf_dir}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if x != int(x) else str(int(x))
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return str(x)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark_df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """What differs, or nothing."""
    a = rows(spark_df.columns, spark_df.collect())
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    b = rows(names, cur.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"
    return ""
