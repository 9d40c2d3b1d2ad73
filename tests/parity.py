"""Compares a Spark query with its DuckDB SQL as sets of rows."""

from __future__ import annotations

import collections
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cell(x):
    """Truth values, whole numbers and others stay apart; others count alike
    up to nine places."""
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else ("number", round(float(x), 9))
    return ("whole", x) if isinstance(x, int) else x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, c, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, otherwise what differs."""
    df = query(spark, sf_dir)
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    left, right = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, cur.fetchall())
    if left == right:
        return "" if left else "both empty"
    return f"{sum(left.values())} rows against {sum(right.values())}; only in Spark {list((left - right).items())[:2]}; only in SQL {list((right - left).items())[:2]}"
