"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import os
import sys
import time



import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def _text(value) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def compare(spark, connection, name: str, query, sql: str | None, sf: str) -> tuple[bool, str]:
    started = time.time()
    frame = query(spark, sf)
    rows = frame.collect()
    spent = time.time() - started
    if sql is None:
        return len(rows) > 0, f"{len(rows)} rows, no SQL, {spent:.1f}s"
    want = connection.execute(sql)
    names = [column[0] for column in want.description]
    if sorted(frame.columns) != sorted(names):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}"
    got, expected = rows_of(frame.columns, rows), rows_of(names, want.fetchall())
    if got == expected:
        return True, f"{len(got)} rows, {spent:.1f}s"
    only_got = [row for row in got if row not in set(expected)][:3]
    only_expected = [row for row in expected if row not in set(got)][:3]
    return False, f"{len(got)} rows against {len(expected)}; ours {only_got}; wanted {only_expected}; {sorted(names)}"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    chosen = sys.argv[1:]
    spark, connection = make_session(), connect(sf)
    bad = 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if chosen and not any(part in name for part in chosen):
            continue
        try:
            good, note = compare(spark, connection, name, query, oracles.get(name), sf)
        except Exception as error:
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{len(queries)} queries, {len(oracles)} with SQL, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
