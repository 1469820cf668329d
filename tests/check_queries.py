"""Run registered queries next to their plain SQL and compare values.
usage: python tests/check_queries.py [name-prefix ...]  (SF_DIR names the data)"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as contract
from lexiscreen.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(normal(row[k]) for k in order) for row in rows)


def compare(spark, con, folder, name, function, sql):
    started = time.time()
    df = function(spark, folder)
    got = df.collect()
    took = time.time() - started
    if sql is None:
        return f"rows-only {len(got)} rows {took:.1f}s", bool(got), took
    rel = con.sql(sql)
    columns = rel.columns
    want = rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} <> {sorted(columns)}", False, took
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [r for r in a if r not in in_b][:3]
        only_b = [r for r in b if r not in in_a][:3]
        return f"MISMATCH {len(a)} / {len(b)} rows\n   spark {only_a}\n   sql   {only_b}", False, took
    return f"ok {len(a)} rows {took:.1f}s", bool(a), took


def main(prefixes):
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, sql = contract.queries(), contract.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        try:
            text, fine, _ = compare(spark, con, folder, name, function, sql.get(name))
        except Exception as error:
            text, fine = f"ERROR {str(error)[:600]}", False
        bad += not fine
        print("@@" if fine else "@@ !!", name, text, flush=True)
    print("@@ bad", bad, "of", len(queries), "with sql", len(sql))
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
