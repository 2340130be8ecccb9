"""File sources.  Schemas are declared by the caller, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratawave import lookups
from stratawave.functions import scalars


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a header line; quoted fields may hold line breaks only if the file says so."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, from its header line only."""
    return spark.read.option("header", True).csv(path).columns


def resolve_columns(columns: Sequence[str], index: str | None = None,
                    numeric: Sequence[str] = ()) -> tuple[str, str]:
    """Pick the date and the value column of an index source at plan time.

    Known aliases come first, then a date-like heading, then the first numeric
    column, then the first column that is not the date.
    """
    dates = [c for c in lookups.DATE_ALIASES if c in columns]
    dates += [c for c in columns if any(word in c.lower() for word in ("date", "time", "period"))]
    if not dates:
        raise ValueError(f"no date-like column among {list(columns)}")
    date = dates[0]
    values = [c for c in lookups.VALUE_ALIASES.get((index or "").lower(), ("value",)) if c in columns]
    values += [c for c in columns if c in numeric and c != date]
    values += [c for c in columns if c != date]
    if not values:
        raise ValueError(f"no value column among {list(columns)}")
    return date, values[0]


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def index_from_table(df: DataFrame, index: str) -> DataFrame:
    """Any date/value table as ``(index, date, value)``, values coerced to numbers."""
    date, value = resolve_columns(df.columns, index, numeric_columns(df))
    number = F.col(value) if value in numeric_columns(df) else scalars.coerce_number(F.col(value))
    return df.select(
        F.lit(index.lower()).alias("index"),
        scalars.parse_month(F.col(date)).alias("date"),
        scalars.clean_double(number.cast("double")).alias("value"),
    )


def split_quoted_lines(lines: DataFrame, names: Sequence[str], value: str = "value") -> DataFrame:
    """Repair of exports whose whole line is one quoted field.

    Quotes are removed, the line is split on commas, and only lines with exactly
    ``len(names)`` fields are kept.
    """
    fields = F.split(F.regexp_replace(value, '"', ""), ",")
    return lines.select(fields.alias("_f")).where(F.size("_f") == len(names)).select(
        *[F.col("_f")[i].alias(n) for i, n in enumerate(names)]
    )


def read_quoted_lines(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Lines of a single-column CSV; its header does not parse as data and is dropped."""
    parts = split_quoted_lines(spark.read.text(path), names)
    return parts.where(F.col(names[0]).try_cast("date").isNotNull())


def sheet_dates(df: DataFrame, column: str) -> DataFrame:
    """Wide price sheet with a ``1960M01`` column: real dates, and rows that have none fail.

    The failure is an expression of the row itself, so it needs no extra pass.
    """
    month = scalars.parse_month(F.col(column))
    checked = F.coalesce(month, F.raise_error(F.concat(F.lit("bad month: "), F.col(column).cast("string"))).cast("date"))
    return df.select(checked.alias("date"), *[c for c in df.columns if c != column])


