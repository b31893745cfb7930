"""Run registered queries and their SQL twins side by side and compare rows.

    python tools/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from panelcast.catalog import ORACLES, QUERIES  # noqa: E402
from panelcast.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp",
}


def sortable(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def compare(spark_rows, spark_types, con, sql) -> str:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    types = {n: KINDS.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    if names != sorted(spark_types):
        return f"columns differ: {sorted(spark_types)} / {names}"
    off = {n: (spark_types[n], types[n]) for n in names if spark_types[n] != types[n]}
    if off:
        return f"types differ: {off}"
    order = [rel.columns.index(n) for n in names]
    want = sorted((tuple(x[i] for i in order) for x in rel.fetchall()), key=sortable)
    have = sorted((tuple(x[n] for n in names) for x in spark_rows), key=sortable)
    if len(want) != len(have):
        return f"rows differ: {len(have)} / {len(want)}"
    bad = [(h, w) for h, w in zip(have, want) if not all(map(same, h, w))]
    exact = sum(h != w for h, w in zip(have, want))
    if bad:
        return f"{len(bad)} of {len(want)} rows differ, e.g. {names}\n   {bad[0][0]}\n   {bad[0][1]}"
    return f"ok {len(want)} rows" + (f" ({exact} equal only to 1e-12)" if exact else "")


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{opt.sf}/{t}.parquet'")
    failed = 0
    for name in opt.names or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, opt.sf)
            rows = df.collect()
            took = time.time() - start
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            if name in ORACLES:
                result = compare(rows, types, con, ORACLES[name])
            else:
                result = f"ok {len(rows)} rows, no twin"
        except Exception as e:  # noqa: BLE001
            took, result = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        if not result.startswith("ok"):
            failed += 1
        print(f"{name:28s} {took:6.1f}s  {result}", flush=True)
    print(f"{failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
