"""Named queries with their check SQL.

A query reads the tables of a folder and returns a DataFrame.  Its SQL computes the
same columns from the same tables; common table expressions are kept once and are
put in front of a statement by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def sql_with(body: str) -> str:
    """``body`` preceded by every table expression it uses, in definition order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    body = body.strip()
    if not parts:
        return body
    if body[:4].upper() == "WITH":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + re.sub(r"^WITH(\s+RECURSIVE)?", "", body, flags=re.IGNORECASE)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query; doubles of its result are rounded to ``digits``."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_with(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def sel(plain: str, doubles: str, source: str, digits: int = 6) -> str:
    """``SELECT`` of plain columns and rounded double columns (names split by spaces)."""
    cols = [f'"{c}"' for c in plain.split()]
    cols += [f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles.split()]
    return f"SELECT {', '.join(cols)} FROM {source}"


def rnd(c: Column | str, digits: int) -> Column:
    return F.round(c, digits)
