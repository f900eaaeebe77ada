"""Runs registered queries beside their SQL twins and compares the rows exactly."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(norm(r[i]) for i in order) for r in rows], sorted(columns)


def compare(spark, con, sf_dir, name, make, sql):
    df = make(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    odd = [d[0] for d in cur.description if str(d[1]).startswith(("DECIMAL", "HUGEINT", "LIST"))]
    if odd:
        return f"SQL types not comparable: {odd}"
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    a, b = Counter(got), Counter(want)
    if a == b:
        return None
    only_a, only_b = sorted((a - b).elements(), key=repr), sorted((b - a).elements(), key=repr)
    return f"{got_cols} rows {len(got)}/{len(want)} differ {len(only_a)}/{len(only_b)}: {only_a[:3]} | {only_b[:3]}"


def main():
    import __spark_entry__ as entry
    from quantloom.session import local_session
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--only", default="")
    p.add_argument("--after", default="", help="only queries registered after this one")
    p.add_argument("--until", default="", help="stop after this one")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{a.sf}"
    con = duck(sf_dir)
    bad, ran = [], 0
    todo = list(entry.queries().items())
    order = [n for n, _ in todo]
    todo = todo[order.index(a.after) + 1 if a.after else 0:order.index(a.until) + 1 if a.until else None]
    for name, make in todo:
        if a.names and name not in a.names:
            continue
        if a.only and not make.__module__.endswith(a.only):
            continue
        t, ran = time.time(), ran + 1
        try:
            problem = compare(spark, con, sf_dir, name, make, entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - t
        if problem:
            bad.append(name)
            print(f"FAIL {name} {took:.1f}s {problem}", flush=True)
        elif took > 6:
            print(f"ok   {name} {took:.1f}s", flush=True)
    print("failed:", len(bad), "of", ran, bad)


if __name__ == "__main__":
    main()
