"""Checks of panels on rows of their own."""

import datetime as dt

import __spark_entry__ as entry
from compare import difference, duck


def test_panel_checks_see_the_gaps(spark, tmp_path):
    months = [dt.date(1995 + m // 12, m % 12 + 1, 5) for m in range(30)]
    brands = {1: "Brand#1", 2: "Brand#2", 3: "Brand#3"}
    spark.createDataFrame(list(brands.items()), "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(p, d, 100.0 + p + i, 2.0) for p in brands for i, d in enumerate(months)]
    spark.createDataFrame(lines, "l_partkey long, l_shipdate date, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["panel_checks"](spark, str(tmp_path))
    bad = {(r["panel"], r["check"]): r["n_bad"] for r in got.collect()}
    assert bad == {
        ("gaps", "duplicate_keys"): 0, ("gaps", "series_with_null_returns"): 3, ("gaps", "series_with_null_volatility"): 3,
        ("whole", "duplicate_keys"): 0, ("whole", "series_with_null_returns"): 0, ("whole", "series_with_null_volatility"): 0,
    }
    con = duck("/root/testdata/sf0.001")
    for name in ("part", "lineitem"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert difference(got.toPandas(), con.execute(entry.oracle_sql()["panel_checks"]).df()) is None
