"""Compare registered queries with their oracle statements: ``python tests/compare.py [sf] [names...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    return names, rel.fetchall()


def difference(spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    names, raw = oracle_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = rows_of(names, raw)
    if got == want:
        return None
    pairs = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"{len(got)} rows vs {len(want)}; first differences (ours, oracle): {pairs}"


def main() -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf, only = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    spark = local_session()
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        if name not in oracle:
            print(f"NO ORACLE {name}")
            continue
        try:
            diff = difference(spark, name, query, oracle[name], f"/root/testdata/sf{sf}")
        except Exception as exc:  # report and go on with the other queries
            diff = str(exc)[:600]
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("unmatched oracle:", sorted(set(oracle) - set(queries)), "bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
