"""Runs a registered query and its SQL twin and compares the row sets."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(df, con, sql: str) -> str:
    """Empty when both sides have the same columns, value types and rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, ours), _rows(names, theirs)

    def kinds(rows: Counter) -> list[set]:
        width = len(names)
        return [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(width)]

    if a != b:
        left, right = list((a - b).elements()), list((b - a).elements())
        return f"{len(ours)} vs {len(theirs)} rows; only spark {left[:3]}; only sql {right[:3]}"
    if kinds(a) != kinds(b):
        return f"types {kinds(a)} != {kinds(b)}"
    return ""
