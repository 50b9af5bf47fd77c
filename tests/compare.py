"""Compare every query with its SQL counterpart: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from bastionlog.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 9)
        return float(v) if type(v).__name__ == "Decimal" else v

    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    """DuckDB with the supplied tables as views."""
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          bastionlog__input__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, bad = oracle_sql(), []
    for name, build in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in oracle:
                print(f"{name}: {len(got[1])} rows, no SQL, {took:.1f}s", flush=True)
                continue
            result = con.execute(oracle[name])
            want = rows_of([d[0] for d in result.description], result.fetchall())
            same = got == want
            print(f"{name}: {'ok' if same else 'DIFFERS'} {len(got[1])}/{len(want[1])} rows, {took:.1f}s, "
                  f"sql {time.time() - start - took:.1f}s", flush=True)
            if not same:
                bad.append(name)
                if got[0] != want[0]:
                    print("   columns", set(got[0]) ^ set(want[0]))
                else:
                    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                    print("   spark only", sorted(a - b)[:2])
                    print("   sql only  ", sorted(b - a)[:2])
        except Exception as error:  # report and go on with the next query
            bad.append(name)
            print(f"{name}: ERROR {str(error)[:700]}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
