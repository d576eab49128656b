"""Compare a Spark query with its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
from pathlib import Path

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) < 1e15 else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(f"{sf_dir}/{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(spark, name: str, sf_dir: str) -> str:
    """Empty when the query and its SQL agree."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = duck(sf_dir).execute(e.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; Spark only: {str(a)[:600]}; SQL only: {str(b)[:600]}"
    return ""


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from loomset.session import local_session

    s = local_session()
    s.sparkContext.setLogLevel("ERROR")
    at, names = sys.argv[1], sys.argv[2:] or list(e.queries())
    for n in names:
        t = time.time()
        try:
            said = differences(s, n, f"{DATA}/{at}") if n in e.oracle_sql() else f"no SQL, {e.queries()[n](s, f'{DATA}/{at}').count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(n, f"{time.time() - t:.1f} s", said or "same", flush=True)
