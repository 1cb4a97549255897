"""Run queries beside their SQL on DuckDB and compare rows, types and values.

    python tests/oracle.py 0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, canon(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
    return v


def kind(v):
    return {"int": "int", "float": "float", "Decimal": "decimal"}.get(type(v).__name__, type(v).__name__)


def compare(df, con, sql) -> str:
    cols = sorted(df.columns)
    spark_rows = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    duck_rows = [tuple(canon(r[i]) for i in at) for r in cur.fetchall()]
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a, b = sorted(spark_rows, key=key), sorted(duck_rows, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first:\n   {cols}\n   S {str(bad[0][0])[:700]}\n   D {str(bad[0][1])[:700]}"
    for c, x, y in zip(cols, a[0] if a else (), b[0] if b else ()):
        if kind(x) != kind(y):
            return f"type of {c}: {kind(x)} vs {kind(y)}"
    return f"ok {len(a)} rows"


def main(sf: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from lectern.session import local_session

    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            verdict = compare(df, con, oracles[name]) if name in oracles else f"rows-only {df.count()}"
        except Exception as exc:  # noqa: BLE001
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        failed += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:34s} {time.time() - started:6.1f}s {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
