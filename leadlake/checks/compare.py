"""Run registered queries in Spark and their SQL twins in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os
import re
from collections import Counter

from pyspark.sql import DataFrame


def _cell(v):
    return (type(v).__name__, str(v))


def spark_rows(df: DataFrame):
    names = sorted(df.columns)
    return names, [tuple(_cell(v) for v in r) for r in df.select(*names).collect()]


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{f}'")
    return con


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(_cell(r[i]) for i in order) for r in cur.fetchall()]


def is_ordered(sql: str) -> bool:
    """Whether the statement itself, not a part of it, puts its rows in order."""
    return re.search(r"\border by\b[^()]*(\([^()]*(\([^()]*\)[^()]*)*\)[^()]*)*$", sql) is not None and not _inside(sql)


def _inside(sql: str) -> bool:
    """Whether the last ``order by`` stands in brackets."""
    behind = sql[sql.rindex("order by"):]
    return behind.count(")") > behind.count("(")


def difference(df: DataFrame, con, sql: str) -> str | None:
    """None if equal, else a short description of the first differences. Rows that the twin
    puts in order have to come in this order."""
    names, in_order = spark_rows(df)
    want_names, want_order = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} vs {want_names}"
    got, want = Counter(in_order), Counter(want_order)
    if got == want:
        if is_ordered(sql) and in_order != want_order:
            at = next(k for k, (a, b) in enumerate(zip(in_order, want_order, strict=True)) if a != b)
            return f"order, from row {at}: {in_order[at]} vs {want_order[at]}"[:1500]
        return None
    extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"rows {sum(got.values())} vs {sum(want.values())}; only Spark {extra}; only SQL {missing}"[:1500]
