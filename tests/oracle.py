"""Run a registered query in Spark and in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    started = time.monotonic()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.monotonic() - started
    if sql is None:
        return True, f"rows-only {len(got)} rows {took:.2f}s"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        extra, lack = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(got)} vs {len(want)} rows; only spark {str(extra)[:700]}; only sql {str(lack)[:700]}"
    return True, f"{len(got)} rows {took:.2f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    directory = f"/root/testdata/sf{sf}"
    session = build_session()
    duck = connect(directory)
    oracles, bad = entry.oracle_sql(), 0
    for key, query in entry.queries().items():
        if wanted and not any(w in key for w in wanted):
            continue
        try:
            ok, note = compare(session, duck, key, query, oracles.get(key), directory)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", key, note, flush=True)
    print("failures:", bad)
