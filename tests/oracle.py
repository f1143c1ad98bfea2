"""Run registered queries against their DuckDB text and report differences.

``python -m tests.oracle [sf] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from aisle import plans
from aisle.session import local_session
from aisle.sources.standins import RAW_TABLES


def connect(directory: str):
    con = duckdb.connect()
    for name in RAW_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(value + 0.0))
    return (1, str(value))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def compare(spark, con, directory: str, name: str) -> tuple[str, str]:
    df = plans.queries()[name](spark, directory)
    columns, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    text = plans.oracle_sql().get(name)
    if text is None:
        return "rows-only", f"{len(rows)} rows"
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    expected_columns, expected = normal(names, cursor.fetchall())
    if columns != expected_columns:
        return "FAIL", f"columns {columns} / {expected_columns}"
    if len(rows) != len(expected):
        return "FAIL", f"row count {len(rows)} / {len(expected)}"
    different = [(a, b) for a, b in zip(rows, expected) if a != b]
    if different:
        pairs = "\n    ".join(
            str([(c, x[1], y[1]) for c, x, y in zip(columns, a, b) if x != y]) for a, b in different[:3]
        )
        return "FAIL", f"{len(different)} of {len(rows)} rows differ\n    {pairs}"
    return "ok", f"{len(rows)} rows"


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    directory = f"/root/testdata/sf{sf}"
    names = [n for n in plans.queries() if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    failed = 0
    for name in names:
        start = time.time()
        try:
            status, note = compare(spark, con, directory, name)
        except Exception as error:  # report and go on with the next query
            status, note = "ERROR", str(error)[:1500]
        failed += status in ("FAIL", "ERROR")
        print(f"{status:9} {name:32} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
