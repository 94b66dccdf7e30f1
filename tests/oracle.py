"""Compare registered queries with their SQL: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]",
    "array<string>": "VARCHAR[]", "date": "DATE", "array<double>": "DOUBLE[]", "array<float>": "FLOAT[]",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0 if value else 0.0)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def compare(spark, con, sf_dir, fn, sql):
    """Empty text when equal, else what differs; plus the row count."""
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if sql is None:
        return "", len(got)
    result = con.execute(sql)
    sql_types = {c[0]: str(c[1]) for c in result.description}
    rows = result.fetchall()
    if sorted(sql_types) != columns:
        return f"columns {columns} != {sorted(sql_types)}", len(got)
    order = [list(sql_types).index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in rows]
    problems = []
    for c in columns:
        if TYPES.get(types[c], types[c]) != sql_types[c].upper():
            problems.append(f"type of {c}: {types[c]} vs {sql_types[c]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if sorted(got) != sorted(want):
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        problems.append(f"{len(extra)} extra, {len(missing)} missing; {str(extra[:2])[:600]} <> {str(missing[:2])[:600]}")
    return "; ".join(problems), len(got)


def main():
    from faultline.cluster import local_session
    from faultline.registry import ORACLE, QUERIES

    args = sys.argv[1:]
    sf = args.pop(0) if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = [n for n in QUERIES if not args or any(a in n for a in args)]
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, QUERIES[name], ORACLE.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += bool(problem)
        kind = "rows" if name not in ORACLE else "hash"
        print(f"{'FAIL' if problem else 'ok  '} {name:40s} {kind} {n:8d} {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"{len(names)} queries, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
