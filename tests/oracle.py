"""Row-for-row comparison of a Spark query with its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when both give the same bag of rows."""
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    wanted = bag(names, relation.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if not wanted:
        return ["the SQL gives no rows, so nothing is checked"]
    if got == wanted:
        return []
    missing, extra = list((wanted - got).items()), list((got - wanted).items())
    return [f"{sum(got.values())} rows instead of {sum(wanted.values())}",
            f"missing {len(missing)}, e.g. {missing[:3]}", f"extra {len(extra)}, e.g. {extra[:3]}"]
