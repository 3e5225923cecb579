"""Compare a registered query with its SQL on DuckDB, value by value."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from lectern.plans.registry import TABLES

TYPE = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
    "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT",
}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )


def compare(spark, folder, name, query, sql):
    """Return (problem or None, rows, spark seconds)."""
    t0 = time.time()
    df = query(spark, folder)
    types = dict(df.dtypes)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return (None if got else "no rows"), len(got), took
    con = connect(folder)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} vs {sorted(want_cols)}", len(got), took
    bad = {c: (t, want_types[c]) for c, t in types.items() if TYPE.get(t) != want_types[c]}
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    problem = f"types {bad}" if bad else None
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3] if len(a) < 200000 else []
        only_b = [r for r in b if r not in set(a)][:3] if len(b) < 200000 else []
        problem = f"{problem or ''} rows {len(a)} vs {len(b)}\n  spark: {only_a}\n  sql:   {only_b}"
    elif not a:
        problem = f"{problem or ''} empty"
    return problem, len(got), took


def main(argv):
    from lectern.session import build_session
    import __spark_entry__ as entry

    folder = argv[1]
    wanted = argv[2:]
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        skip = [w[1:] for w in wanted if w.startswith("-")]
        take = [w for w in wanted if not w.startswith("-")]
        if (take and not any(w in query_group(name) for w in take)) or any(w in query_group(name) for w in skip):
            continue
        try:
            problem, n, took = compare(spark, folder, name, query, oracles.get(name))
        except Exception as e:  # report and go on
            problem, n, took = f"{type(e).__name__}: {str(e)[:900]}", -1, 0.0
        flag = "ok " if problem is None else "BAD"
        kind = "" if name in oracles else " (rows only)"
        print(f"{flag} {name}{kind} rows={n} {took:.1f}s" + (f"\n    {problem}" if problem else ""), flush=True)
        failed += problem is not None
    print(f"failed={failed}")


def query_group(name):
    import __spark_entry__ as entry

    return f"{name} @{entry.group_of(name)}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv)
