"""Runs registered queries beside their SQL in DuckDB: python tests/oracle.py [NAME ...]."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return f"{x + 0.0:.6g}"
        return "null" if x is None else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


def compare(spark, con, f, sql) -> tuple[int, str]:
    """Number of rows, and what differs ('' if nothing)."""
    df = f(spark, SF)
    names = sorted(df.columns)
    got = plain(df.select(names).collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return len(got), f"columns {names} and {sorted(rel.columns)}"
    want = plain(con.sql(f"select {', '.join(names)} from ({sql})").fetchall())
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return len(got), f"{len(got)} and {len(want)} rows; only Spark {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return len(got), ""


def main(names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, bad = duck(), e.queries(), 0
    for name, sql in e.oracle_sql().items():
        if names and not any(n in name for n in names):
            continue
        began = time.time()
        try:
            n, why = compare(spark, con, queries[name], sql)
        except Exception as x:  # noqa: BLE001  shown and counted
            n, why = -1, f"{type(x).__name__} {str(x)[:600]}"
        bad += bool(why) or n == 0
        print(f"{name}: {n} rows, {time.time() - began:.1f} s{': ' + why if why else ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
