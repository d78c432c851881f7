"""Run registered queries against their SQL in DuckDB and report differences.

python tools/check.py [--sf 0.01] [--hot] [name-prefix ...]
"""

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from fieldorder.plans import load_queries
from fieldorder.sources.tables import Tables

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    try:
        if pd.isna(v):
            return "null"
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if type(v).__name__.startswith(("int", "uint")):
        return str(int(v))
    if type(v).__name__.startswith("float"):
        return repr(float(v) + 0.0)
    return str(v)


def kind(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "integer", "bigint"):
        return "int"
    return {"varchar": "string", "timestamp_ntz": "timestamp", "float": "double"}.get(t, t)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def compare(spark, con, q, folder, hot=None):
    t0 = time.time()
    df = q.build(Tables(spark, folder, hot))
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    t1 = time.time()
    if q.sql is None:
        return f"rows-only n={len(got)}", t1 - t0, 0.0
    rel = con.sql(q.sql)
    names, types = rel.columns, [str(t) for t in rel.types]
    want = pd.DataFrame(rel.fetchall(), columns=names, dtype=object)
    t2 = time.time()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(set(got.columns) ^ set(want.columns))}", t1 - t0, t2 - t1
    st = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    dt = {n: kind(t) for n, t in zip(names, types)}
    bad_types = {n: (st[n], dt[n]) for n in st if st[n] != dt[n] and not any(c in dt[n] for c in "[(")}
    a, b = rows_of(got), rows_of(want)
    note = f" TYPES {bad_types}" if bad_types else ""
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"VALUES {len(a)} vs {len(b)} {sorted(got.columns)} {diff}{note}", t1 - t0, t2 - t1
    return ("ok" if not note else "MISMATCH") + f" n={len(a)}{note}", t1 - t0, t2 - t1


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--hot", action="store_true")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    todo = [q for n, q in load_queries().items() if not args.names or any(n.startswith(p) for p in args.names)]
    for q in todo:
        try:
            res, a, b = compare(spark, con, q, folder, args.hot or None)
        except Exception as e:  # report and go on
            res, a, b = "ERROR " + str(e).strip()[:700], 0, 0
        if not res.startswith(("ok", "rows-only")):
            bad += 1
        print(f"{q.name:34s} {a:6.2f}s {b:6.2f}s {res}", flush=True)
    print(f"{len(todo)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
