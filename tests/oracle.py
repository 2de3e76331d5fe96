"""Compare a query with its SQL oracle: names, rows and values, in any order."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(flat, key=repr)


def compare(spark, con, query, sql: str, folder: str) -> tuple[str | None, int]:
    """(first difference or None, rows)."""
    df = query(spark, folder)
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = _table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}", len(got[1])
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{a!r:.400} instead of {b!r:.400}", len(got[1])
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {a!r:.200} instead of {b!r:.200}", len(got[1])
    return None, len(got[1])


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sys.argv[1])
    failed = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                problem, rows = None, query(spark, folder).count()
            else:
                problem, rows = compare(spark, con, query, sql, folder)
        except Exception as e:
            problem, rows = f"{type(e).__name__} {str(e)[:600]}", -1
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={rows} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
