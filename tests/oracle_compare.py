"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python -m tests.oracle_compare [SF_DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from foldwise.plans.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (2, round(v, 6))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return (3, tuple(_norm(x) for x in v))
    return (4, str(v)) if not isinstance(v, (int, bool)) else (2, float(v))


def rows_of(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(out, key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    got = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "rows": len(got), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    exp = con.execute(sql).df()
    res["oracle_rows"] = len(exp)
    if sorted(got.columns) != sorted(exp.columns):
        res["status"] = f"COLUMNS {sorted(got.columns)} != {sorted(exp.columns)}"
        return res
    if len(got) != len(exp):
        res["status"] = "ROWCOUNT"
        return res
    a, b = rows_of(got), rows_of(exp)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    res["status"] = "ok" if not bad else f"VALUES {len(bad)} differ, e.g. {bad[0]}"
    res["spark_types"] = dict(sdf.dtypes)
    return res


def main(argv):
    from tests.session import local_session
    from foldwise.plans.registry import load
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    q, o = load()
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for n in (names or sorted(q)):
        try:
            r = compare(spark, con, n, q[n], o.get(n), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r["name"], r["status"], r.get("rows"), r.get("oracle_rows"), r.get("spark_s"), flush=True)
    print(f"{bad} problems of {len(names or q)}")


if __name__ == "__main__":
    main(sys.argv[1:])
