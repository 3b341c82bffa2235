"""Compare every query with its DuckDB statement: columns, rows and values, order ignored.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tradewind.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return ("num", float(v))
    if isinstance(v, float):
        return ("num", v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def kind(name: str) -> str:
    n = name.lower()
    for k, words in {
        "int": ("bigint", "int", "hugeint", "long"), "float": ("double", "float"), "str": ("varchar", "string"),
        "date": ("date",), "ts": ("timestamp", "timestamp_ntz"), "bool": ("boolean",),
    }.items():
        if n in words:
            return k
    return n


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_columns = df.columns
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(got_columns):
        return f"columns {sorted(got_columns)} != {sorted(rel.columns)}"
    ours = {f.name: kind(f.dataType.typeName()) for f in df.schema.fields}
    theirs = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}
    types = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
    want = rel.fetchall()
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got, got_columns), normal(want, rel.columns)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        return f"{len(bad)} rows differ ({sorted(got_columns)}), first: {bad[0]}"
    if not want:
        return "both empty"
    return f"types {types}" if types else None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    con = connect(sf_dir)
    missing = sorted(set(entry.oracle_sql()) - set(entry.queries()))
    failed = [f"statement without query: {m}" for m in missing]
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception:  # noqa: BLE001
            problem = traceback.format_exc(limit=-3)[-900:]
        mark = "ok  " if problem is None else "FAIL"
        has = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{mark} {time.time() - start:6.2f}s {name}{has} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
