"""Run a registered query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import sys
import time

import duckdb

from foliant.session import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "\\N"
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, build, sql):
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    problem = None
    if sorted(names) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} != {sorted(names)}"
    elif got != want:
        a, b = set(got), set(want)
        problem = f"rows {len(got)} vs {len(want)}; only spark {str(sorted(a - b)[:2])[:900]}; only sql {str(sorted(b - a)[:2])[:900]}"
    return len(got), problem


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from foliant.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark, con = build_session("compare"), connect(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, build in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, sf_dir, build, sqls.get(name))
        except Exception as exc:  # report and go on with the next query
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
        took = time.time() - t
        tag = "BAD " if problem else ("ok  " if name in sqls else "rows")
        bad += bool(problem)
        print(f"{tag} {name:34s} rows={n:6d} {took:6.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
