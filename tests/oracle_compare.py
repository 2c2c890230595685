"""Spark-vs-DuckDB comparison, the same shape as the driver's correctness gate.

Run as a script:  python tests/oracle_compare.py [sf_dir] [name ...]
Plans instead:    python tests/oracle_compare.py --explain [sf_dir] name ...
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.10g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, tuples):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in tuples]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name: str, fn, oracle: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if oracle is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(oracle)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    res["oracle_rows"] = len(o_rows)
    if sorted(s_cols) != sorted(o_cols):
        res["status"] = f"SCHEMA spark={sorted(s_cols)} oracle={sorted(o_cols)}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(o_cols, o_rows)
    if a == b:
        res["status"] = "ok"
    else:
        diff_a = [r for r in a if r not in b][:3]
        diff_b = [r for r in b if r not in a][:3]
        res["status"] = f"VALUES spark-only={diff_a} oracle-only={diff_b}"
    return res


def main(argv):
    explain = "--explain" in argv
    argv = [a for a in argv if a != "--explain"]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    if explain:
        import __spark_entry__ as entry
        from trendscope.session import get_session
        spark = get_session()
        for name in names:
            print(f"== {name}")
            entry.queries()[name](spark, sf_dir).explain("formatted")
        return 0
    import __spark_entry__ as entry
    from trendscope.session import get_session
    spark = get_session()
    con = duck(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, con, name, qs[name], oracle.get(name), sf_dir)
        except Exception as exc:  # report and continue
            r = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names or qs) - bad} ok / {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
