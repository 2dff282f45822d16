"""Run registered queries against their DuckDB statements: python -m catalog.compare [names]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def cell(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return str(value)


def canonical(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, build, sql: str | None) -> tuple[bool, str]:
    begin = time.time()
    df = build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_time = time.time() - begin
    if sql is None:
        return True, f"{name}: {len(rows)} rows, no statement ({spark_time:.1f}s)"
    begin = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    duck_time = time.time() - begin
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(set(names) ^ set(df.columns))}"
    left, right = canonical(df.columns, rows), canonical(names, expected)
    if left == right:
        return True, f"{name}: {len(rows)} rows ({spark_time:.1f}s / {duck_time:.1f}s)"
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    return False, f"{name}: {len(left)} vs {len(right)} rows\n  {sorted(names)}\n  spark {only_left}\n  duckdb {only_right}"


def main() -> None:
    from catalog.oracles import ORACLES
    from catalog.queries import QUERIES
    from tickerloom.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    wanted = [a for a in sys.argv[1:] if not a.startswith("/")] or list(QUERIES)
    for a in sys.argv[1:]:
        if a.startswith("/"):
            sf_dir = a
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in wanted:
        try:
            good, line = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            good, line = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        bad += not good
        print("ok  " if good else "BAD ", line, flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
