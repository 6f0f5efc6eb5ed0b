"""Compare registered queries with their DuckDB SQL: python tests/compare.py [SF_DIR] [NAME...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value if isinstance(value, (int, bool, str)) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def differences(spark, sf_dir, query, sql):
    """Rows on one side only, and how many rows there are."""
    df = query(spark, sf_dir)
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs_names, theirs = oracle_rows(sf_dir, sql)
    if names != theirs_names:
        return [("columns", names, theirs_names)], len(mine)
    if len(mine) != len(theirs):
        a, b = set(mine), set(theirs)
        return [("rows", len(mine), len(theirs), sorted(a - b, key=repr)[:3], sorted(b - a, key=repr)[:3])], len(mine)
    return [(a, b) for a, b in zip(mine, theirs, strict=True) if not close(a, b)][:5], len(mine)


def close(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b, strict=True))


if __name__ == "__main__":
    import __spark_entry__ as entry
    from traceaudit.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        began = time.time()
        try:
            if name in sqls:
                diff, n = differences(spark, sf_dir, queries[name], sqls[name])
            else:
                diff, n = [], queries[name](spark, sf_dir).count()
        except Exception as e:
            diff, n = [("error", type(e).__name__, str(e)[:1500])], 0
        bad += bool(diff) or not n
        print(f"{'FAIL' if diff else 'ok' if name in sqls else 'rows only'} {name}: {n} rows, {time.time() - began:.1f} s", *diff, sep="\n    " if diff else " ", flush=True)
    print("bad:", bad)
