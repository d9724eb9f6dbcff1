"""Compare every query with its SQL, row by row, on one data folder."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


_FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
           "timestamp_ntz": "TIMESTAMP"}


def difference(spark, con, sf: str, query, sql: str) -> str | None:
    df = query(spark, sf)
    con.execute(sql)
    names = [d[0] for d in con.description]
    kinds = {d[0]: str(d[1]) for d in con.description}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for name, kind in df.dtypes:
        if _FAMILY.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    mine, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, con.fetchall())
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} rows != {len(theirs)}; {str(extra)[:600]}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {str(wrong[0])[:900]}" if wrong else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    folder = sys.argv[1]
    only = set(sys.argv[2:])
    session, con = make_session(), connect(folder)
    sql = oracle_sql()
    print("without SQL:", sorted(set(queries()) - set(sql)), "orphans:", sorted(set(sql) - set(queries())))
    for name, query in queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            problem = difference(session, con, folder, query, sql[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
