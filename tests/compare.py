"""Run registered queries against their DuckDB oracles.

    python -m tests.compare [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute("set memory_limit='6GB'")
    con.execute("set temp_directory=''")  # an oracle that needs to spill is wrong
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return repr(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    cols = df.columns
    if sql is None:
        return len(got), None, ""
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    print(f"    spark {t1 - t0:.1f}s oracle {time.time() - t1:.1f}s", end=" ")
    c1, r1 = rows_of(cols, [tuple(r) for r in got])
    c2, r2 = rows_of(ocols, want)
    if c1 != c2:
        return len(got), False, f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return len(got), False, f"rows {len(r1)} != {len(r2)}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        diff = sorted(set(r1) - set(r2))[:2], sorted(set(r2) - set(r1))[:2]
        return len(got), False, f"{len(bad)} rows differ {c1}\n   {diff[0]}\n   {diff[1]}"[:1800]
    return len(got), True, ""


def main(argv):
    import __spark_entry__ as e
    from nightgrid.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    subs = argv[1:]
    spark = build_session()
    con = duck(sf_dir)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if subs and not any(s in name for s in subs):
            continue
        t = time.time()
        try:
            n, ok, why = compare(spark, con, fn, os_.get(name), sf_dir)
        except Exception as x:  # report and go on
            n, ok, why = -1, False, f"{type(x).__name__}: {str(x)[:700]}"
        bad += ok is False
        print(f"{'ok ' if ok else 'rows' if ok is None else 'BAD'} {name} rows={n} {time.time()-t:.1f}s {why}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
