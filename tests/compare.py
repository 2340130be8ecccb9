"""Run registered queries next to their SQL and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(object)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        elif "datetime" in str(df[c].dtype):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v)[:10]).astype(object)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else v if isinstance(v, bool) else str(v)[:10] if "date" in str(type(v)) else v)
    df = df.astype(object).where(df.notna(), None)
    key = df.apply(lambda r: tuple("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r), axis=1)
    return df.iloc[key.argsort(kind="stable").to_numpy()].reset_index(drop=True) if len(df) else df


def difference(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    a, b = normal(a), normal(b)
    bad = []
    for c in a.columns:
        for i, (x, y) in enumerate(zip(a[c], b[c])):
            if x is None and y is None or x == y:
                continue
            bad.append((i, c, x, y))
    if bad:
        return f"{len(bad)} cells differ, first {bad[:3]}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from stratawave.session import get_session

    sf = "/root/testdata/sf0.01"
    names = []
    for arg in argv:
        if arg.startswith("sf"):
            sf = f"/root/testdata/{arg}"
        else:
            names.append(arg)
    queries, sqls = entry.queries(), entry.oracle_sql()
    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                    "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    for name in [n for n in queries if not names or any(n.startswith(x) for x in names)]:
        start = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
        except Exception as e:  # report and go on with the next query
            failed += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in sqls:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            want = con.execute(sqls[name]).df()
        except Exception as e:
            failed += 1
            print(f"SQL   {name}: {str(e)[:1500]}", flush=True)
            continue
        problem = difference(got, want)
        failed += problem is not None
        print(f"{'FAIL ' if problem else 'ok   '} {name}: {len(got)} rows {took:.1f}s sql {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
