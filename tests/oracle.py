"""Compare registered queries with their SQL on the given tables.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from millrace.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _sortable(row):
    return [(v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in row]


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both results hold the same rows, else what differs first."""
    names = sorted(spark_df.columns)
    mine = [tuple(_cell(r[n]) for n in names) for r in spark_df.collect()]
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns {names} / {sorted(found)}"
    at = [found.index(n) for n in names]
    theirs = [tuple(_cell(r[i]) for i in at) for r in cursor.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows / {len(theirs)} rows"
    mine.sort(key=_sortable)
    theirs.sort(key=_sortable)
    for a, b in zip(mine, theirs, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(names, a))} / {dict(zip(names, b))}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    chosen = sys.argv[2:] or list(entry.queries())
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            if name in sql:
                problem = difference(df, con, sql[name])
                state = "same" if problem is None else f"DIFFERENT {problem}"
            else:
                state = f"{len(df.collect())} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            state = f"FAILED {type(error).__name__} {str(error)[:600]}"
        bad += state.startswith(("DIFFERENT", "FAILED"))
        print(f"{name:32s} {time.time() - start:6.2f}s  {state}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
