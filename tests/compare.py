"""Run registered queries in Spark and their SQL twins in DuckDB and compare values.

Usage: python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in records), key=repr
    )


def compare(spark, con, name, query, sql, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"{name}: {len(got)} rows, no SQL twin, spark {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    exp = cur.fetchall()
    t2 = time.time()
    ca, a = rows_of(df.columns, got)
    cb, b = rows_of(cols, exp)
    head = f"{name}: spark {len(a)} rows {t1 - t0:.1f}s, duckdb {len(b)} rows {t2 - t1:.1f}s"
    if ca != cb:
        return False, f"{head} COLUMNS {ca} != {cb}"
    if len(a) != len(b):
        return False, f"{head} ROWS DIFFER {a[:2]} {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(i) for i in x] != [type(i) for i in y]]
    if bad:
        return False, f"{head} {len(bad)} VALUES DIFFER\n   spark  {bad[0][0]}\n   duckdb {bad[0][1]}"
    note = "" if a else " EMPTY"
    return True, head + note


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from barloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    names = argv[1:] or list(qs)
    failed = []
    for n in names:
        try:
            ok, text = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as exc:  # report and go on
            ok, text = False, f"{n}: ERROR {type(exc).__name__} {str(exc)[:1500]}"
        print(("ok   " if ok else "FAIL ") + text, flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
