"""Run queries and their SQL side by side: ``python -m checks.compare [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from checks.registry import ORACLE, QUERIES

ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in ALL_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool):
        return str(value)
    return repr(value)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    return normalised(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, name):
    cursor = con.execute(ORACLE[name])
    return normalised([d[0] for d in cursor.description], cursor.fetchall())


def main(names: list[str]) -> int:
    from sparkcurate.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names or QUERIES:
        try:
            start = time.time()
            columns, rows = spark_rows(spark, sf_dir, name)
            took = time.time() - start
            if name not in ORACLE:
                print(f"{name:28s} rows={len(rows):7d} {took:6.2f}s  (no SQL)", flush=True)
                continue
            start = time.time()
            expected = oracle_rows(con, name)
            sql_took = time.time() - start
            same = (columns, rows) == expected
            print(
                f"{name:28s} rows={len(rows):7d} {took:6.2f}s sql={sql_took:5.2f}s "
                f"{'ok' if same else 'DIFFERENT'}", flush=True,
            )
            if not same:
                bad += 1
                print("   columns", columns, expected[0], "rows", len(rows), len(expected[1]))
                shown = 0
                for a, b in zip(rows, expected[1]):
                    if a != b:
                        for x, y in zip(a, b):
                            if x != y:
                                at = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                                print("   spark ", a[0][:30], x[max(0, at - 60) : at + 120])
                                print("   oracle", b[0][:30], y[max(0, at - 60) : at + 120])
                        shown += 1
                        if shown == 2:
                            break
        except Exception as exc:  # keep going: this is a report
            bad += 1
            print(f"{name:28s} ERROR {str(exc)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
