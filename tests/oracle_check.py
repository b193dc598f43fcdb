"""Run every registered query against its SQL counterpart.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(comparable(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )


def compare(spark, con, query, sql, sf_dir):
    """(equal, Spark rows, SQL rows, schemas)."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    types = {d[0]: str(d[1]) for d in cur.description}
    return sorted(df.columns) == sorted(names) and got == want, got, want, (df.dtypes, types)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from barscreen import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = build_session(), duck(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, query in queries().items():
        if name not in sqls or only and name not in only:
            continue
        start = time.time()
        try:
            equal, got, want, types = compare(spark, con, query, sqls[name], sf_dir)
        except Exception as error:  # noqa: BLE001 - the run goes on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        print(f"{'ok  ' if equal else 'DIFF'} {name} {len(got)} {len(want)} {time.time() - start:.2f}s",
              flush=True)
        if only:
            print(types)
        if not equal:
            bad += 1
            print("  ", types)
            extra = [r for r in got if r not in want][:3] if len(got) < 20000 else got[:3]
            lack = [r for r in want if r not in got][:3] if len(got) < 20000 else want[:3]
            print("   spark only:", extra, "\n   sql only:", lack)
    return bad


if __name__ == "__main__":
    sys.exit(main())
