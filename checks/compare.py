"""Run queries in Spark and their SQL in DuckDB and compare rows, types and values.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from codecloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SQL_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _clean(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_clean(row[i]) for i in order) for row in rows)


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf)
    got_rows = [tuple(r) for r in df.collect()]
    spark_time = time.time() - start
    start = time.time()
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    cursor_types = cursor.description
    want_rows = cursor.fetchall()
    sql_time = time.time() - start
    got, want = _bag(df.columns, got_rows), _bag(columns, want_rows)
    note = f"{len(got_rows)} rows, spark {spark_time:.1f}s, sql {sql_time:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    types = dict(df.dtypes)
    sql_types = {d[0]: SQL_TYPES.get(str(d[1]), str(d[1])) for d in cursor_types}
    if types != sql_types:
        odd = {c: (types[c], sql_types[c]) for c in types if types[c] != sql_types[c]}
        return False, f"types {odd}"
    if got != want:
        only_got = list((got - want).elements())[:3]
        only_want = list((want - got).elements())[:3]
        return False, f"{note}; {len(want_rows)} wanted; only spark {only_got}; only sql {only_want}"
    return True, note


def main(argv: list[str]) -> int:
    sf, names = argv[0], argv[1:] or list(QUERIES)
    spark, con = local_session(8), oracle_connection(sf)
    failed = []
    for name in names:
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as exc:  # report every query, whatever goes wrong in one
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} equal; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
