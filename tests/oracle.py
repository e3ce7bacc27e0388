"""Compare a Spark result with the same query in DuckDB, value by value."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return "DEC " + str(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    spark_cols, spark_rows = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    sql_cols, sql_rows = normal(names, cur.fetchall())
    if spark_cols != sql_cols:
        return f"columns {spark_cols} != {sql_cols}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}; spark {spark_rows[:2]} sql {sql_rows[:2]}"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if bad:
        only_spark = sorted(set(spark_rows) - set(sql_rows))[:3]
        only_sql = sorted(set(sql_rows) - set(spark_rows))[:3]
        return f"{len(bad)} rows differ; columns {spark_cols}; spark {only_spark} sql {only_sql}"
    return None
