"""Compare registered queries with their oracle SQL: ``python -m tests.oracle [--sf DIR] [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value that compares alike from either engine."""
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf_dir)
    mine, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), duck(sf_dir, sql)
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows"
    return next((f"{a} and {b}" for a, b in zip(mine[1], theirs[1], strict=True) if a != b), "")


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for i, a in enumerate(args) if a != "--sf" and args[i - 1] != "--sf"] or list(entry.queries())
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        t = time.time()
        try:
            sql = entry.oracle_sql().get(n)
            said = compare(spark, sf_dir, entry.queries()[n], sql) if sql else f"no SQL; {entry.queries()[n](spark, sf_dir).count()} rows"
            bad += bool(sql and said)
        except Exception as e:  # noqa: BLE001
            said, bad = f"{type(e).__name__}: {str(e)[:1500]}", bad + 1
        print(f"{n}: {said[:1500] or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
