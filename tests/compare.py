"""Run registered queries and compare each with its SQL check in DuckDB.

    python tests/compare.py [--sf 0.01] [--explain] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark, sf_dir: str, query, sql: str, con, counts: list[int] | None = None) -> str | None:
    """None if both sides agree, else what differs. ``counts`` receives the row count."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if counts is not None:
        counts.append(len(got))
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first only here: {next((r for r in got if r not in want), None)}"
    for mine, theirs in zip(got, want):
        if mine != theirs or [type(x) for x in mine] != [type(x) for x in theirs]:
            return f"row {mine} != {theirs}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from quayside import get_session

    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con, queries, oracles = duck(sf_dir), entry.queries(), entry.oracle_sql()
    wanted = args.names or list(queries)
    bad = 0
    for name in [n for n in queries if any(w in n for w in wanted)]:
        start = time.time()
        try:
            if args.explain:
                queries[name](spark, sf_dir).explain("formatted")
            if name in oracles:
                counts: list[int] = []
                found = difference(spark, sf_dir, queries[name], oracles[name], con, counts)
                rows = f"ok {counts[0]} rows"
            else:
                found, rows = None, f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            found, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += found is not None
        print(f"{name:40s} {time.time() - start:6.2f}s {'DIFF ' + found if found else rows}", flush=True)
    print(f"{bad} differences")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
