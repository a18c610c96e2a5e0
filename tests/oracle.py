"""Run a named query in Spark and its SQL twin in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, fn, sql: str, sf_dir: str, allow_empty: bool = False):
    """(equal, note, spark seconds)."""
    start = time.time()
    df = fn(spark, sf_dir)
    left = df.collect()
    seconds = time.time() - start
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    right = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}", seconds
    declared = {d[0]: str(d[1]) for d in result.description}
    wrong = {c: (t, declared[c]) for c, t in df.dtypes if TYPES.get(t) != declared[c]}
    if wrong:
        return False, f"declared types {wrong}", seconds
    if not left and not allow_empty:
        return False, "no rows", seconds
    a, b = rows_of(df.columns, [tuple(r) for r in left]), rows_of(columns, right)
    if len(a) != len(b):
        return False, f"{len(a)} rows vs {len(b)}", seconds
    for x, y in zip(a, b):
        if x != y:
            return False, f"{sorted(columns)}\n   spark {x}\n   sql   {y}", seconds
        if [type(v) for v in x] != [type(v) for v in y]:
            return False, f"types {x} vs {y}", seconds
    return True, f"{len(a)} rows", seconds


def main():
    import __spark_entry__ as E
    from pricetide.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("8")
    con = connect(sf_dir)
    sqls = E.oracle_sql()
    for name, fn in E.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                ok, note, seconds = compare(spark, con, name, fn, sqls[name], sf_dir)
            else:
                rows = fn(spark, sf_dir).collect()
                ok, note, seconds = bool(rows), f"{len(rows)} rows, no twin, e.g. {str(rows[:2])[:300]}", time.time() - start
        except Exception as error:  # report and go on
            ok, note, seconds = False, f"{type(error).__name__}: {str(error)[:1500]}", time.time() - start
        print("ok  " if ok else "FAIL", name, f"{seconds:.2f}s", note, flush=True)


if __name__ == "__main__":
    main()
