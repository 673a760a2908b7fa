"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

Usage: python tools/compare.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if glob.glob(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if value != value else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """Return (ok, message)."""
    df = query(spark, sf_dir)
    cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows-only {len(rows)}"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_cols, want = canonical(want_cols, cur.fetchall())
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return False, f"rows {len(rows)} != {len(want)}"
    kinds = {c: str(t) for c, t in zip(df.columns, [f.dataType for f in df.schema])}
    bad = [(a, b) for a, b in zip(rows, want) if repr(a) != repr(b)]
    if bad:
        return False, f"{len(bad)}/{len(rows)} differ {cols} e.g. {bad[0][0]} vs {bad[0][1]} {kinds}"
    return True, f"rows {len(rows)}"


def main(argv):
    from cohortlift.plans.catalog import ORACLES, QUERIES
    from cohortlift.session import local_session

    sf_dir, prefixes = argv[0], argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    failures = []
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            ok, msg = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as err:  # report and go on to the next query
            ok, msg = False, f"{type(err).__name__}: {str(err)[:700]}"
        if not ok:
            failures.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {msg}", flush=True)
    print(f"{len(failures)} failures: {failures}")


if __name__ == "__main__":
    main(sys.argv[1:])
