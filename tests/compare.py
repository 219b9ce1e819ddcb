"""Run queries beside their SQL and compare: python -m tests.compare [--sf DIR] NAME..."""

import glob
import math
import os
import sys
import time
from collections import Counter


def norm(v):
    import datetime
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def compare(spark, con, sf, name, query, sql, show=4):
    t = time.time()
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = Counter(norm(tuple(r)) for r in df.select(*cols).collect())
    took = time.time() - t
    if sql is None:
        return True, f"{name}: {sum(got.values())} rows, no SQL, {took:.1f} s"
    t = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return False, f"{name}: columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(norm(tuple(r[i] for i in order)) for r in rel.fetchall())
    t = time.time() - t
    ok = got == want
    text = f"{name}: {'ok' if ok else 'DIFFERS'}, {sum(got.values())} rows against {sum(want.values())}, {took:.1f} s ({t:.1f})"
    if not ok:
        text += f"\n  only here: {list((got - want).items())[:show]}\n  only SQL: {list((want - got).items())[:show]}"
    return ok, text


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", "/tmp/quillsift-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, q, s = duck(sf), e.queries(), e.oracle_sql()
    bad = []
    for n in args or q:
        try:
            ok, text = compare(spark, con, sf, n, q[n], s.get(n))
        except Exception as x:  # noqa: BLE001
            ok, text = False, f"{n}: {type(x).__name__} {str(x)[:1500]}"
        print(text, flush=True)
        if not ok:
            bad.append(n)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
