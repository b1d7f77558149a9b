"""Compare every registered query with its DuckDB oracle (like the driver's check).

usage: python tests/oracle_check.py [sf_dir] [name ...] [--json PATH]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from sigmaflow.session import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def normalise(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="last", kind="mergesort").reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"COLUMNS spark={sorted(a.columns)} oracle={sorted(b.columns)}"
    if len(a) != len(b):
        return f"ROWS spark={len(a)} oracle={len(b)}"
    a, b = normalise(a), normalise(b)
    bad = []
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_float_dtype(x) or pd.api.types.is_float_dtype(y):
            xv, yv = x.astype(float).to_numpy(), y.astype(float).to_numpy()
            # equal values with the same sign bit (a value hash sees -0.0 != 0.0)
            same = ((xv == yv) & (np.signbit(xv) == np.signbit(yv))) | (np.isnan(xv) & np.isnan(yv))
            if not same.all():
                d = np.nanmax(np.abs(xv - yv))
                bad.append(f"{c}: {int((~same).sum())} differ (max {d:.3g})")
        else:
            xs = x.astype(str).to_numpy()
            ys = y.astype(str).to_numpy()
            if not (xs == ys).all():
                i = int(np.argmax(xs != ys))
                bad.append(f"{c}: {int((xs != ys).sum())} differ e.g. {xs[i]!r} vs {ys[i]!r}")
    return "OK" if not bad else "VALUES " + "; ".join(bad)


def main() -> None:
    args = sys.argv[1:]
    json_path = None
    if "--json" in args:
        i = args.index("--json")
        json_path = args[i + 1]
        args = args[:i] + args[i + 2:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    only = set(args[1:])
    report = {}
    spark = get_spark("local[8]")
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    failures = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as ex:  # noqa: BLE001
            print(f"{name:34s} SPARK-ERROR {str(ex)[:300]}")
            report[name] = {"status": "spark-error"}
            failures += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:34s} rows-only  rows={len(sdf)}  {ts:.1f}s")
            report[name] = {"status": "rows-only", "rows": len(sdf), "sec": round(ts, 2)}
            continue
        try:
            odf = con.sql(sql[name]).df()
        except Exception as ex:  # noqa: BLE001
            print(f"{name:34s} ORACLE-ERROR {str(ex)[:300]}")
            report[name] = {"status": "oracle-error"}
            failures += 1
            continue
        res = compare(sdf, odf)
        failures += res != "OK"
        print(f"{name:34s} {res}  rows={len(sdf)}  {ts:.1f}s")
        report[name] = {"status": res, "rows": len(sdf), "sec": round(ts, 2)}
    print("failures:", failures)
    if json_path:
        import json
        with open(json_path, "w") as fh:
            json.dump({"sf_dir": sf_dir, "failures": failures, "queries": report}, fh, indent=1)


if __name__ == "__main__":
    main()
