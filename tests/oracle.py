"""Run registered queries on Spark and their SQL on DuckDB and compare. CLI: python -m tests.oracle [sf] [prefix ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows_of(names, rows):
    idx = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in idx) for r in rows)


def compare(spark: SparkSession, con, folder: str, fn, sql: str):
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(names, cur.fetchall())
    problem = None
    if sorted(names) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} != {sorted(names)}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} != {len(want)}"
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problem = f"{len(bad)} rows differ, e.g. {sorted(names)} {bad[:3]}"
    simple = {"long": "bigint", "int": "integer", "string": "varchar"}
    kinds = {f.name: simple.get(f.dataType.typeName().replace("integer", "int"), f.dataType.typeName()) for f in df.schema}
    drift = {n: (kinds[n], t) for n, t in types.items() if n in kinds and kinds[n].lower() != t.lower()}
    return len(got), problem, drift


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from cliploom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                n, problem, drift = compare(spark, con, folder, fn, sqls[name])
            else:
                n, problem, drift = fn(spark, folder).count(), None, {}
        except Exception as e:  # noqa: BLE001
            n, problem, drift = -1, f"{type(e).__name__}: {str(e)[:1500]}", {}
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5}{name:40}{n:9} {time.time() - t0:6.1f}s {problem or ''} {drift or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
