"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def tidy(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda c: c.map(lambda v: "null" if pd.isna(v) else (f"{v + 0.0:.9g}" if isinstance(v, float) else str(v))))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    kinds = [
        (c, spark_frame[c].dtype.kind, sql_frame[c].dtype.kind)
        for c in sorted(spark_frame.columns)
        if {spark_frame[c].dtype.kind, sql_frame[c].dtype.kind} == {"i", "f"} and not sql_frame[c].isna().any()
    ]
    if kinds:
        return f"types {kinds}"
    a, b = tidy(spark_frame), tidy(sql_frame)
    if a.equals(b):
        return None
    wrong = (a != b).any(axis=1)
    return f"{int(wrong.sum())} rows differ, first:\n{a[wrong].head(3)}\n{b[wrong].head(3)}"


def main(folder: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from mixedframe.session import local_session

    spark, con, sql, bad = local_session(), duck(folder), oracle_sql(), []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - started
            note = difference(got, con.execute(sql[name]).df()) if name in sql else f"rows only ({len(got)})\n{got.head(4)}"
            state = "ok" if note is None else ("--" if name not in sql else "BAD")
        except Exception as e:  # noqa: BLE001
            took, state, note = time.time() - started, "BAD", f"{type(e).__name__}: {str(e)[:1500]}"
        if state == "BAD":
            bad.append(name)
        print(f"{state} {name} {took:.2f}s {note or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
