"""Compare a Spark result with its SQL counterpart, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides agree, else what is wrong."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns differ: {sorted(spark_df.columns)} / {sorted(names)}"]
    want = rows_of(names, cur.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(want) != len(got):
        only = [r for r in set(got) ^ set(want)][:4]
        return [f"rows differ: {len(got)} / {len(want)}", *map(str, only)]
    wrong = [f"{g} / {e}" for g, e in zip(got, want) if g != e]
    return wrong[:4] and [f"{len(wrong)} of {len(want)} rows differ", *wrong[:4]]
