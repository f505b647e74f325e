"""Run a registered query in Spark and its oracle SQL in DuckDB; compare
column names, row counts and the multiset of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v):
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v if isinstance(v, (int, str, bool)) else str(v)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in sdf.collect()]
    rel = con.sql(sql)
    o_cols = rel.columns
    o_raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(o_cols)}
    if sorted(s_cols) != sorted(o_cols):
        return False, f"columns differ: spark={sorted(s_cols)} oracle={sorted(o_cols)}"
    o_rows = [tuple(_norm(r[idx[c]]) for c in sorted(o_cols)) for r in o_raw]
    if len(s_rows) != len(o_rows):
        return False, f"row counts differ: spark={len(s_rows)} oracle={len(o_rows)}"
    cs, co = Counter(s_rows), Counter(o_rows)
    if cs != co:
        only_s = list((cs - co).elements())[:3]
        only_o = list((co - cs).elements())[:3]
        return False, f"values differ ({sorted(s_cols)}): spark-only={only_s} oracle-only={only_o}"
    return True, f"{len(s_rows)} rows"
