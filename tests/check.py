"""Run named queries against their DuckDB SQL: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_frame(sql: str, root: str) -> pd.DataFrame:
    con = duckdb.connect(config={"memory_limit": "8GB", "threads": 6})
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{root}/{t}.parquet'")
    return con.sql(sql).df()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        kind = out[c].dtype.kind
        if kind == "f":
            out[c] = out[c].astype(float)
        elif kind == "b":
            out[c] = out[c].astype(str)
        elif kind not in "iu":
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v)[:10] if hasattr(v, "year") else str(v))
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    a, b = canonical(left), canonical(right)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind and {a[c].dtype.kind, b[c].dtype.kind} - set("fiu"):
            return f"{c}: type {a[c].dtype} vs {b[c].dtype}"
        if "f" in (a[c].dtype.kind, b[c].dtype.kind):
            x, y = a[c].astype(float), b[c].astype(float)
            bad = ~(((x - y).abs() <= 1.5e-6) | (x.isna() & y.isna()))
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {bad.sum()} differ, first {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tideline.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    root = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    names = [n for pattern in names for n in queries if n == pattern or (pattern.endswith("*") and n.startswith(pattern[:-1]))]
    spark = build_session()
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, root).toPandas()
            took = time.time() - start
            mid = time.time()
            if name not in oracles:
                print(f"ROWS {name} rows={len(got)} {took:.1f}s", flush=True)
                continue
            problem = difference(got, oracle_frame(oracles[name], root))
            line = f"{'OK  ' if problem is None else 'FAIL'} {name} rows={len(got)} spark={took:.1f}s duck={time.time()-mid:.1f}s {problem or ''}"
        except Exception as error:  # report and go on to the next query
            problem = str(error)
            line = f"FAIL {name} {type(error).__name__} {problem[:600]}"
        failed += problem is not None
        print(line, flush=True)
        spark.catalog.clearCache()
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
