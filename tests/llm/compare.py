"""Compare the corpus queries with their DuckDB text: ``python -m tests.llm.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

from aisle.llm import queries
from aisle.session import local_session
from tests.oracle import connect, normal


def compare(spark, con, directory: str, name: str) -> str:
    df = queries.queries()[name](spark, directory)
    columns, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected_columns, expected = normal(names, cursor.fetchall())
    assert columns == expected_columns
    assert len(rows) == len(expected)
    different = [(a, b) for a, b in zip(rows, expected, strict=True) if a != b]
    assert not different, different[:2]
    return f"{len(rows)} rows"


if __name__ == "__main__":
    directory = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    session = local_session("compare")
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    for query in sys.argv[2:] or queries.oracle_sql():
        start = time.time()
        print(query, compare(session, connection, directory, query), f"{time.time() - start:.1f}s", flush=True)
