"""Queries on sources, cleaning, reshaping, joins and aggregation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratawave.functions import scalars
from stratawave.operators import aggregate, checks, clean, joins, reshape, series, sets
from stratawave.plans import inputs as I
from stratawave.plans.registry import query
from stratawave.schemas import LONG_PRICES, PANEL, struct
from stratawave.session import checkpoint_folder
from stratawave.sources import readers, specs, writers

IDX = '"index"'


def _target(spark: SparkSession, name: str) -> str:
    """A fresh place for a round trip, in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/roundtrip-{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources


@query("csv_round_trip", "SELECT series, date, price + 0.0 AS price FROM prices")
def csv_round_trip(spark, sf):
    """Write the panel as CSV and read it back with the declared schema."""
    path = _target(spark, "csv")
    writers.save(I.unit_prices(spark, sf).select("date", "series", "price"), path, fmt="csv")
    return readers.read_csv(spark, path, LONG_PRICES)


@query("resolved_index_table", """
SELECT 'orders_level' AS "index", CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  round(avg(o_totalprice), 6) + 0.0 AS value FROM orders GROUP BY 2""")
def resolved_index_table(spark, sf):
    """A table with unknown headings: the date-like and the first numeric column are found."""
    raw = readers.read_table(spark, sf, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice")
    rows = readers.index_from_table(raw.select("o_orderdate", "o_totalprice", "o_orderstatus"), "orders_level")
    return rows.groupBy("index", "date").agg(F.avg("value").alias("value"))


@query("quoted_lines", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(o_orderkey AS VARCHAR) AS time_period,
  o_orderstatus AS ciss_value FROM orders WHERE o_orderkey % 3 <> 0""")
def quoted_lines(spark, sf):
    """Lines that arrive as one quoted field; lines with other than three fields are dropped."""
    orders = readers.read_table(spark, sf, "orders")
    line = F.concat(
        F.lit('"'), F.col("o_orderdate").cast("date").cast("string"), F.lit(","), F.col("o_orderkey").cast("string"),
        F.lit(',""'), F.col("o_orderstatus"), F.lit('"""'),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(",extra")).otherwise(F.lit("")),
    )
    return readers.split_quoted_lines(orders.select(line.alias("value")), ["date", "time_period", "ciss_value"])


@query("sheet_dates", "SELECT date, " + ", ".join(f"max(CASE WHEN series = '{t}' THEN price END) + 0.0 AS {t.lower()}" for t in I.TYPES) + " FROM prices GROUP BY 1")
def sheet_dates(spark, sf):
    """Wide sheet whose months are written 1995M01."""
    wide = reshape.to_wide(I.unit_prices(spark, sf), ["date"], "series", "price", list(I.TYPES))
    sheet = wide.select(F.concat(F.year("date"), F.lit("M"), F.date_format("date", "MM")).alias("month"),
                        *[F.col(t).alias(t.lower()) for t in I.TYPES])
    return readers.sheet_dates(sheet, "month")


@query("month_parsing", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders
WHERE o_orderkey % 4 <> 3 GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM orders WHERE o_orderkey % 4 = 3""")
def month_parsing(spark, sf):
    """Dates written three ways, and texts that are no date."""
    orders = readers.read_table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM"))
        .when(kind == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("M"), F.date_format("o_orderdate", "MM")))
        .otherwise(F.lit("not a date"))
    )
    return orders.select(scalars.parse_month(text).alias("date")).groupBy("date").agg(F.count("*").alias("n"))


@query("save_by_index", f"SELECT {IDX}, count(*) AS n, min(date) AS first, max(date) AS last FROM idx GROUP BY 1")
def save_by_index(spark, sf):
    """One folder per index, read back by partition."""
    path = _target(spark, "index")
    writers.save_by_index(I.indices(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("index").cast("string").alias("index")).agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )


@query("run_summary", """
SELECT 'panel' AS stage, count(*) AS n_obs, count(DISTINCT series) AS n_series, min(date) AS date_start,
  max(date) AS date_end, count(*) - count(price) AS n_missing,
  round(100.0 * avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 2) + 0.0 AS pct_missing FROM gappy""")
def run_summary(spark, sf):
    return writers.run_row(writers.panel_summary(I.gappy_brands(spark, sf)), "panel").drop("run_at", "note")


@query("run_log_append", """
SELECT stage, count(*) AS n_rows, sum(n_obs)::BIGINT AS n_obs FROM (
  SELECT 'types' AS stage, count(*) AS n_obs FROM prices UNION ALL SELECT 'brands', count(*) FROM gappy) s GROUP BY 1""")
def run_log_append(spark, sf):
    """Two stages append to one run table."""
    path = _target(spark, "log")
    writers.append_run(writers.run_row(writers.panel_summary(I.unit_prices(spark, sf)), "types"), path)
    writers.append_run(writers.run_row(writers.panel_summary(I.gappy_brands(spark, sf)), "brands"), path)
    return spark.read.parquet(path).groupBy("stage").agg(F.count("*").alias("n_rows"), F.sum("n_obs").alias("n_obs"))


_LISTS = """
SELECT series, CASE WHEN count(price) >= 71 THEN 'retained' ELSE 'dropped' END AS status, count(price) AS n_obs,
  min(date) AS date_start, max(date) AS date_end,
  round(100.0 * avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 2) + 0.0 AS pct_missing FROM gappy GROUP BY 1"""


@query("series_lists", _LISTS)
def series_lists(spark, sf):
    prices = I.gappy_brands(spark, sf)
    return writers.series_lists(prices, clean.complete_series(prices, 71)[0])


@query("latest_per_key", """
SELECT o_custkey, o_orderdate::DATE AS o_orderdate, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) s WHERE rn = 1""")
def latest_per_key(spark, sf):
    """Newest order of each customer."""
    orders = readers.read_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return writers.latest(orders, ["o_custkey"], "o_orderdate", ties=["o_orderkey"]).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date")
    )


@query("latest_by_file_time", """
SELECT o_custkey, coalesce(recent, whole) AS n, CASE WHEN recent IS NULL THEN 'first' ELSE 'second' END AS version FROM (
  SELECT o_custkey, count(*) AS whole, nullif(count(*) FILTER (o_orderdate >= DATE '1997-01-01'), 0) AS recent FROM orders GROUP BY 1) s""")
def latest_by_file_time(spark, sf):
    """Orders of each customer from the newer of two stored versions; the second one holds the customers of late orders only."""
    orders = readers.read_table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    path = _target(spark, "versions")
    for version, rows in (("first", orders), ("second", orders.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("date")))):
        counts = rows.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("version", F.lit(version))
        writers.save(counts, f"{path}/{version}")
    return writers.latest_by_file(spark, path, ["o_custkey"])


@query("summary_upsert", """
SELECT series, n, src FROM (SELECT series, count(*) AS n, 'new' AS src FROM prices WHERE date >= DATE '1999-01-01' AND series < 'M' GROUP BY 1)
UNION ALL SELECT series, count(*), 'old' FROM prices WHERE series >= 'M' GROUP BY 1""")
def summary_upsert(spark, sf):
    """New summary rows replace the old ones of the same series."""
    prices = I.unit_prices(spark, sf)
    old = prices.groupBy("series").agg(F.count("*").alias("n")).withColumn("src", F.lit("old"))
    new = prices.where((F.col("date") >= "1999-01-01") & (F.col("series") < "M")).groupBy("series").agg(
        F.count("*").alias("n")).withColumn("src", F.lit("new"))
    return writers.upsert(old, new, ["series"])


@query("content_manifest")
def content_manifest(spark, sf):
    """File, bytes and sha256 of the parquet files of the folder."""
    return writers.file_manifest(spark, sf, "*.parquet")


@query("content_hash")
def content_hash(spark, sf):
    return writers.content_hash(I.unit_prices(spark, sf))


_spec_names = ", ".join(
    f"('{s[0]}', 'shocks', '{k}')" for s in I.SPECS for k in s[4]
) + ", " + ", ".join(f"('{s[0]}', 'schedule', '{i[0]}')" for s in I.SPECS for i in s[5]) + ", " + ", ".join(
    f"('{s[0]}', 'scenarios', '{i[1]}')" for s in I.SPECS for i in s[9]) + ", ('resp_small', 'impulse', 'SMALL')"


@query("scenario_spec_issues", f"""
SELECT name, 'error' AS level, source || ' uses unknown variable ' || impulse AS what
FROM (VALUES {_spec_names}) AS v(name, source, impulse)
WHERE impulse NOT IN (SELECT p_type FROM part WHERE p_type < 'P')""")
def scenario_spec_issues(spark, sf):
    """Specs against a model that knows only some of the part types."""
    variables = readers.read_table(spark, sf, "part").where(F.col("p_type") < "P").select(F.col("p_type").alias("variable"))
    return specs.spec_issues(I.specs(spark), variables.distinct())


# ----------------------------------------------------------------- cleaning

@query("coerce_numbers", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN o_orderkey + 0.5::DOUBLE WHEN 3 THEN -o_orderkey::DOUBLE
  WHEN 4 THEN 1000.0::DOUBLE + o_orderkey % 1000 END + 0.0 AS value FROM orders""")
def coerce_numbers(spark, sf):
    """Texts with missing tokens, signs, units and grouping marks to numbers."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, F.lit("n/a")).when(k % 5 == 1, F.lit("."))
        .when(k % 5 == 2, F.concat(F.lit("$ "), k.cast("string"), F.lit(".5 USD")))
        .when(k % 5 == 3, F.concat(F.lit("-"), k.cast("string")))
        .otherwise(F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
    )
    raw = readers.read_table(spark, sf, "orders").select("o_orderkey", text.alias("value"))
    return clean.coerce_columns(raw, ["value"])


@query("type_report", """
SELECT 'date' AS "column", 'date' AS found, TRUE AS type_ok, count(*) - count(date) AS n_null FROM gappy
UNION ALL SELECT 'series', 'string', TRUE, count(*) - count(series) FROM gappy
UNION ALL SELECT 'price', 'double', TRUE, count(*) - count(price) FROM gappy
UNION ALL SELECT 'unit', NULL, FALSE, count(*) FROM gappy""")
def type_report(spark, sf):
    return clean.type_report(I.gappy_brands(spark, sf), struct(date=T.DateType(), series=T.StringType(),
                                                               price=T.DoubleType(), unit=T.StringType()))


_DICT = {"standard": "std", "economy": "eco", "medium": "med", "promo": "pro", "large": "big", "small": "tiny"}
_dict = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_DICT.items()))
_MESSY = """CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || 'x' WHEN 2 THEN left(p_type, length(p_type) - 1)
  ELSE 'Qq' || p_type || 'Zz' END"""


def _messy(spark, sf) -> DataFrame:
    t, k = F.col("p_type"), F.col("p_size") % 4
    name = (
        F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("x")))
        .when(k == 2, F.substring("p_type", 1, 20).substr(F.lit(1), F.length(t) - 1)).otherwise(F.concat(F.lit("Qq"), t, F.lit("Zz")))
    )
    return readers.read_table(spark, sf, "part").select("p_partkey", name.alias("series"), "p_retailprice")


_NEAR = f"""
SELECT original, clean, CASE WHEN distance <= 2 THEN matched END AS matched,
  CASE WHEN distance <= 2 THEN mapped ELSE clean END AS mapped, CASE WHEN distance <= 2 THEN distance END AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY original ORDER BY distance, pos) AS rn FROM (
    SELECT original, clean, d.key AS matched, d.val AS mapped, d.pos, CAST(damerau_levenshtein(clean, d.key) AS INTEGER) AS distance
    FROM (SELECT original, CASE WHEN original = 'PROMO' THEN 'promotion' ELSE
            regexp_replace(lower(regexp_replace(original, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g') END AS clean
          FROM (SELECT DISTINCT {_MESSY} AS original FROM part) o) n,
    (VALUES {_dict}) AS d(pos, key, val)) x) y WHERE rn = 1"""


@query("name_mapping_report", _NEAR)
def name_mapping_report(spark, sf):
    """Explicit names, snake case, then the nearest dictionary name within two edits."""
    return clean.standardize_series_names(_messy(spark, sf), explicit={"PROMO": "promotion"}, dictionary=_DICT)[1]


@query("renamed_rows", f"""
SELECT m.mapped AS series, count(*) AS n, round(sum(p_retailprice), 4) + 0.0 AS total
FROM (SELECT {_MESSY} AS original, p_retailprice FROM part) p JOIN ({_NEAR}) m USING (original) GROUP BY 1""")
def renamed_rows(spark, sf):
    """Data rows under their canonical names."""
    rows = clean.standardize_series_names(_messy(spark, sf), explicit={"PROMO": "promotion"}, dictionary=_DICT)[0]
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("total"))


@query("coalesce_renamed", """
SELECT date, name, price + 0.0 AS price FROM (
  SELECT date, name, price, row_number() OVER (PARTITION BY date, name ORDER BY price IS NULL, pos) AS rn FROM (
    SELECT date, 'group_' || CAST(CAST(regexp_extract(series, '(\\d+)', 1) AS INTEGER) % 5 AS VARCHAR) AS name,
      CAST(regexp_extract(series, '(\\d+)', 1) AS INTEGER) AS pos, price FROM gappy) s) r WHERE rn = 1""")
def coalesce_renamed(spark, sf):
    """Series folded into five names: first value in column order."""
    number = F.regexp_extract("series", r"(\d+)", 1).cast("int")
    rows = I.gappy_brands(spark, sf).select(
        "date", F.concat(F.lit("group_"), (number % 5).cast("string")).alias("name"), number.alias("pos"), "price"
    )
    return clean.coalesce_renamed(rows, "name", "pos")


@query("index_names", """
SELECT raw, CASE lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) WHEN 'vixindex' THEN 'VIX' WHEN 'jlnum3m' THEN 'JLN'
  WHEN 'cissindex' THEN 'CISS' WHEN 'vxo' THEN 'VXO' ELSE raw END AS name, n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'VIX Index' WHEN 'view' THEN 'jlnum3m' WHEN 'error' THEN 'CISS_Index'
    WHEN 'purchase' THEN 'vxo' ELSE event_type END AS raw, count(*) AS n FROM events GROUP BY 1) e""")
def index_names(spark, sf):
    e = F.col("event_type")
    raw = F.when(e == "click", "VIX Index").when(e == "view", "jlnum3m").when(e == "error", "CISS_Index").when(
        e == "purchase", "vxo").otherwise(e)
    return readers.read_table(spark, sf, "events").groupBy(raw.alias("raw")).agg(F.count("*").alias("n")).select(
        "raw", scalars.index_name(F.col("raw")).alias("name"), "n")


@query("index_cleaners", """
SELECT 'vix' AS "index", o_orderdate::DATE AS date, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2
UNION ALL SELECT 'ciss', o_orderdate::DATE, count(*), round(sum(o_totalprice), 2) + 0.0 FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2""")
def index_cleaners(spark, sf):
    """Source layouts of two indices to one shape; rows without a value are dropped."""
    orders = readers.read_table(spark, sf, "orders")
    value = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string"))
    day = F.col("o_orderdate").cast("date").cast("string")
    vix = clean.clean_index(orders.select(day.alias("observation_date"), value.alias("VIXCLS")), "vix")
    ciss = clean.clean_index(orders.select(day.alias("TIME_PERIOD"), value.alias("CISS_value")), "ciss")
    return clean.union_all([vix, ciss]).groupBy("index", "date").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("study_set", "SELECT series, count(*) AS n FROM prices WHERE series IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY 1")
def study_set(spark, sf):
    return clean.study_set(I.unit_prices(spark, sf), ["economy", "Small", "PROMO", "Titanium"]).groupBy("series").agg(
        F.count("*").alias("n"))


@query("study_set_missing", """
SELECT member FROM (VALUES ('economy'), ('small'), ('titanium'), ('zinc')) AS v(member)
WHERE member NOT IN (SELECT lower(p_type) FROM part)""")
def study_set_missing(spark, sf):
    return clean.missing_members(readers.read_table(spark, sf, "part").withColumnRenamed("p_type", "series"),
                                 ["economy", "Small", "Titanium", "zinc"])


@query("complete_series", """
SELECT series, date, price + 0.0 AS price FROM gappy WHERE series IN
  (SELECT series FROM gappy GROUP BY 1 HAVING count(price) >= 71)""")
def complete_series(spark, sf):
    return clean.complete_series(I.gappy_brands(spark, sf), 71)[0]


@query("complete_series_summary", """
SELECT count(*) AS n_series, sum(CASE WHEN n >= 71 THEN 1 ELSE 0 END)::BIGINT AS retained,
  sum(CASE WHEN n < 71 THEN 1 ELSE 0 END)::BIGINT AS dropped,
  round(100.0 * avg(CASE WHEN n >= 71 THEN 1.0 ELSE 0.0 END), 1) + 0.0 AS retained_pct, 71 AS min_obs
FROM (SELECT series, count(price) AS n FROM gappy GROUP BY 1) s""")
def complete_series_summary(spark, sf):
    return clean.complete_series(I.gappy_brands(spark, sf), 71)[2]


@query("date_window", "SELECT series, count(*) AS n, min(date) AS lo, max(date) AS hi FROM prices WHERE date >= DATE '1996-03-01' AND date <= DATE '2000-06-30' GROUP BY 1")
def date_window(spark, sf):
    return clean.date_window(I.unit_prices(spark, sf), "1996-03-01", "2000-06-30").groupBy("series").agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))


def _brand_panel(spark, sf) -> DataFrame:
    """Brand returns with the level index: holes in both."""
    returns = series.log_return(I.gappy_brands(spark, sf), out="ret")
    vol = I.indices(spark, sf).where(F.col("index") == "vol")
    return joins.merge_index(returns, vol).withColumn("ret", F.round("ret", 10))


_BPANEL = """SELECT r.series, r.date, r.price, round(r.ret, 10) AS ret, i.value
FROM bret r LEFT JOIN (SELECT date, value FROM idx WHERE "index" = 'vol') i USING (date)"""


@query("row_mask", f"""
SELECT series, date, miss FROM (SELECT *, (price IS NULL)::INT + (ret IS NULL)::INT + (value IS NULL)::INT AS miss FROM ({_BPANEL}) p) q
WHERE miss <= 1""")
def row_mask(spark, sf):
    panel = _brand_panel(spark, sf)
    cols = ["price", "ret", "value"]
    return panel.where(clean.row_mask(cols, 1)).select("series", "date", scalars.n_missing(cols).alias("miss"))


@query("common_sample_report", f"""
SELECT count(*) AS rows_before, sum(ok)::BIGINT AS rows_after, round(100.0 * avg(ok), 2) + 0.0 AS pct_retained,
  min(CASE WHEN ok = 1 THEN date END) AS date_start, max(CASE WHEN ok = 1 THEN date END) AS date_end,
  round(avg((price IS NULL)::INT), 3) + 0.0 AS na_price, round(avg((ret IS NULL)::INT), 3) + 0.0 AS na_ret,
  round(avg((value IS NULL)::INT), 3) + 0.0 AS na_value
FROM (SELECT *, ((price IS NOT NULL)::INT + (ret IS NOT NULL)::INT + (value IS NOT NULL)::INT >= 2)::INT AS ok FROM ({_BPANEL}) p) q""")
def common_sample_report(spark, sf):
    return clean.common_sample(_brand_panel(spark, sf), ["price", "ret", "value"], 2)[1]


@query("coverage_with_reason", f"""
SELECT series, round(avg((reason IS NULL)::INT), 6) + 0.0 AS coverage, any_value(top) AS top_reason FROM (
  SELECT p.series, reason, t.top FROM (SELECT series, CASE WHEN price IS NULL THEN 'price' WHEN ret IS NULL THEN 'ret'
      WHEN value IS NULL THEN 'value' END AS reason FROM ({_BPANEL}) a) p
  LEFT JOIN (SELECT series, reason AS top FROM (
     SELECT series, reason, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, reason) AS rn FROM (
       SELECT series, CASE WHEN price IS NULL THEN 'price' WHEN ret IS NULL THEN 'ret' WHEN value IS NULL THEN 'value' END AS reason
       FROM ({_BPANEL}) b) c WHERE reason IS NOT NULL GROUP BY 1, 2) d WHERE rn = 1) t USING (series)) e GROUP BY 1""")
def coverage_with_reason(spark, sf):
    return aggregate.coverage_with_reason(_brand_panel(spark, sf), ["price", "ret", "value"])


@query("complete_dates", """SELECT series, date, round(ret, 6) + 0.0 AS ret FROM fret
WHERE date IN (SELECT date FROM fret GROUP BY 1 HAVING count(ret) = (SELECT count(DISTINCT p_brand) FROM part))""")
def complete_dates(spark, sf):
    """Months on which all brands have a return."""
    n = readers.read_table(spark, sf, "part").agg(F.count_distinct("p_brand")).first()[0]
    returns = series.log_return(I.unit_prices(spark, sf, "p_brand"), out="ret")
    return clean.complete_dates(returns, n).select("series", "date", "ret")


def _with_copies(spark, sf) -> DataFrame:
    """Type returns with a constant series, an exact copy and a near copy added."""
    ret = I.type_returns(spark, sf).where(F.col("ret").isNotNull()).select("series", "date", "ret")
    small = ret.where(F.col("series") == "SMALL")
    return ret.unionByName(small.withColumn("series", F.lit("X_COPY"))).unionByName(
        ret.where(F.col("series") == "LARGE").withColumns({"series": F.lit("Y_NEAR"), "ret": F.col("ret") * (1 + 1e-10)})
    ).unionByName(small.withColumns({"series": F.lit("Z_FLAT"), "ret": F.lit(0.25)}))


@query("varying_series", """
SELECT series, count(*) AS n FROM ret WHERE ret IS NOT NULL GROUP BY 1 HAVING var_samp(ret) > 0
UNION ALL SELECT 'X_COPY', count(ret) FROM ret WHERE series = 'SMALL'
UNION ALL SELECT 'Y_NEAR', count(ret) FROM ret WHERE series = 'LARGE'""")
def varying_series(spark, sf):
    return clean.varying_series(_with_copies(spark, sf)).groupBy("series").agg(F.count("*").alias("n"))


@query("duplicate_series", """
WITH c AS (
  SELECT series, date, ret FROM ret WHERE ret IS NOT NULL
  UNION ALL SELECT 'X_COPY', date, ret FROM ret WHERE ret IS NOT NULL AND series = 'SMALL'
  UNION ALL SELECT 'Y_NEAR', date, ret * (1 + 1e-10::DOUBLE) FROM ret WHERE ret IS NOT NULL AND series = 'LARGE'
  UNION ALL SELECT 'Z_FLAT', date, 0.25 FROM ret WHERE ret IS NOT NULL AND series = 'SMALL'),
n AS (SELECT series, count(*) AS n FROM c GROUP BY 1),
same AS (
  SELECT a.series AS first, b.series FROM c a JOIN c b ON b.date = a.date AND b.series > a.series
  JOIN n na ON na.series = a.series JOIN n nb ON nb.series = b.series
  GROUP BY a.series, b.series, na.n, nb.n HAVING count(*) = na.n AND na.n = nb.n AND sum(abs(a.ret - b.ret)) <= 1.5e-8::DOUBLE * sum(abs(a.ret)))
SELECT series, min(first) AS duplicate_of FROM same GROUP BY 1""")
def duplicate_series(spark, sf):
    return clean.duplicate_series(_with_copies(spark, sf))


@query("typed_panel", """
SELECT series_id, date, price + 0.0 AS price FROM (SELECT series AS series_id, date,
  CASE WHEN month(date) = 6 THEN NULL ELSE price END AS price FROM prices) p""")
def typed_panel(spark, sf):
    raw = I.unit_prices(spark, sf).select(
        F.col("series").alias("series_id"), F.col("date").cast("string").alias("date"),
        F.when(F.month("date") == 6, F.lit("x")).otherwise(F.col("price").cast("string")).alias("price"),
    )
    return clean.typed_panel(raw)


@query("trim_to_index", "SELECT series, count(*) AS n, max(date) AS hi FROM prices WHERE date >= (SELECT min(date) FROM idx) AND date <= (SELECT max(date) FROM idx) GROUP BY 1")
def trim_to_index(spark, sf):
    return clean.trim_to_index(I.unit_prices(spark, sf), I.indices(spark, sf)).groupBy("series").agg(
        F.count("*").alias("n"), F.max("date").alias("hi"))


_GROUPS = (("econ|small", "Low"), ("large|medium", "Mid"), ("promo", "Deal"))


@query("group_labels", """
SELECT p_type, CASE WHEN lower(p_type) LIKE '%econ%' OR lower(p_type) LIKE '%small%' THEN 'Low'
  WHEN lower(p_type) LIKE '%large%' OR lower(p_type) LIKE '%medium%' THEN 'Mid' WHEN lower(p_type) LIKE '%promo%' THEN 'Deal' ELSE 'Other' END AS "group",
  upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS name, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def group_labels(spark, sf):
    return readers.read_table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).select(
        "p_type", scalars.group_label(F.col("p_type"), _GROUPS).alias("group"), scalars.display_name(F.col("p_type")).alias("name"), "n")


@query("study_groups", """
SELECT id, CASE id WHEN 'gold' THEN 'Precious' WHEN 'ngas_us' THEN 'Energy' WHEN 'copper' THEN 'Industrial' WHEN 'maize' THEN 'Agriculture'
  ELSE 'Other' END AS pattern_group, CASE id WHEN 'gold' THEN 'Precious' WHEN 'ngas_us' THEN 'Energy' WHEN 'copper' THEN 'Industrial'
  WHEN 'maize' THEN 'Agriculture' ELSE 'Other' END AS exact_group,
  CASE id WHEN 'ngas_us' THEN 'Natural gas (US)' WHEN 'not_known' THEN 'Not Known' ELSE upper(left(id, 1)) || substr(id, 2) END AS name, n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'gold' WHEN 'view' THEN 'ngas_us' WHEN 'error' THEN 'copper' WHEN 'purchase' THEN 'maize'
    ELSE 'not_known' END AS id, count(*) AS n FROM events GROUP BY 1) e""")
def study_groups(spark, sf):
    e = F.col("event_type")
    key = F.when(e == "click", "gold").when(e == "view", "ngas_us").when(e == "error", "copper").when(
        e == "purchase", "maize").otherwise("not_known")
    return readers.read_table(spark, sf, "events").groupBy(key.alias("id")).agg(F.count("*").alias("n")).select(
        "id", scalars.group_label(F.col("id")).alias("pattern_group"), scalars.study_group(F.col("id")).alias("exact_group"),
        scalars.display_name(F.col("id")).alias("name"), "n")


def _canonical(prices: DataFrame) -> DataFrame:
    priced = series.volatility_proxy(series.panel_returns(prices))
    return prices.sparkSession.createDataFrame([], PANEL).unionByName(clean.canonical_panel(priced))


@query("canonical_panel", """
SELECT date, regexp_replace(lower(series), '[^a-z0-9]+', '_', 'g') AS series_id, series AS series_name, CAST(NULL AS VARCHAR) AS unit,
  price + 0.0 AS price, round(ln(price), 6) + 0.0 AS ln_price, round(ret, 6) + 0.0 AS ret, round(ret * ret, 6) + 0.0 AS vol_proxy FROM fret""")
def canonical_panel(spark, sf):
    """Long prices to the eight-column panel: returns, volatility, slug ids."""
    return _canonical(I.unit_prices(spark, sf, "p_brand"))


@query("folded_labels", """
SELECT CASE WHEN raw IN ('vix', 'VXO', 'vxo_vix') THEN 'Volatility' WHEN raw = 'jln' THEN 'JLN' ELSE raw END AS label, sum(n)::BIGINT AS n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'vix' WHEN 'view' THEN 'VXO' WHEN 'error' THEN 'jln' WHEN 'purchase' THEN 'vxo_vix' ELSE event_type END AS raw,
    count(*) AS n FROM events GROUP BY 1) e GROUP BY 1""")
def folded_labels(spark, sf):
    e = F.col("event_type")
    raw = F.when(e == "click", "vix").when(e == "view", "VXO").when(e == "error", "jln").when(e == "purchase", "vxo_vix").otherwise(e)
    return readers.read_table(spark, sf, "events").groupBy(scalars.fold_proxy(raw).alias("label")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- checks


_panel_checks = " UNION ALL ".join(f"""
SELECT '{panel}' AS panel, 'duplicate_keys' AS "check", 'error' AS level, count(*) AS n_bad FROM (SELECT series, date FROM {rows} GROUP BY 1, 2 HAVING count(*) > 1) d
UNION ALL SELECT '{panel}', 'series_with_null_returns', 'warning', count(*) FROM (SELECT series FROM {rows} GROUP BY 1 HAVING count(*) - count(ret) > 1) r
UNION ALL SELECT '{panel}', 'series_with_null_volatility', 'warning', count(*) FROM (SELECT series FROM {rows} GROUP BY 1 HAVING count(*) - count(ret) > 1) v"""
    for panel, rows in (("gaps", "bret"), ("whole", "fret")))


@query("panel_checks", _panel_checks)
def panel_checks(spark, sf):
    """Checks of the canonical panel with blanked months and of the whole one."""
    panels = {"gaps": _canonical(I.gappy_brands(spark, sf)), "whole": canonical_panel(spark, sf)}
    gaps, whole = (checks.panel_checks(df).select(F.lit(name).alias("panel"), "*") for name, df in panels.items())
    return gaps.unionByName(whole)


@query("parsed_checks", """
SELECT 'few_rows' AS "check", 'error' AS level, (count(*) < 1000)::INT::BIGINT AS n_bad FROM gappy
UNION ALL SELECT 'few_series', 'error', (count(DISTINCT series) < 20)::INT::BIGINT FROM gappy
UNION ALL SELECT 'null_date', 'error', count(*) - count(date) FROM gappy
UNION ALL SELECT 'null_series', 'error', count(*) - count(series) FROM gappy
UNION ALL SELECT 'null_price', 'error', count(*) - count(price) FROM gappy
UNION ALL SELECT 'early_date', 'error', count(*) FROM gappy WHERE date < DATE '1960-01-01'
UNION ALL SELECT 'future_date', 'error', count(*) FROM gappy WHERE date > DATE '2000-01-01' + INTERVAL 60 DAY""")
def parsed_checks(spark, sf):
    return checks.parsed_checks(I.gappy_brands(spark, sf), today=F.lit("2000-01-01").cast("date"))


@query("index_checks", """
SELECT "index", unnest(['too_few_rows', 'duplicate_dates', 'null_values', 'infinite_values', 'negative_values', 'near_constant',
    'irregular_steps', 'spikes', 'early_start']) AS "check",
  unnest(['error', 'error', 'error', 'error', 'error', 'warning', 'warning', 'warning', 'warning']) AS level,
  unnest([(count(*) < 10)::INT, (count(*) - count(DISTINCT date))::INT, (count(*) - count(value))::INT, (count(*) FILTER (isinf(value)))::INT, (count(*) FILTER (value < 0))::INT, (stddev_samp(value) < 1e-6)::INT, (count(DISTINCT step) > 1)::INT,
    (max(abs(value)) / (quantile_cont(value, 0.99) - quantile_cont(value, 0.01) + 1e-5) > 10)::INT, (min(year(date)) < 1980)::INT])::BIGINT AS n_bad
FROM (SELECT *, date - lag(date) OVER (PARTITION BY "index" ORDER BY date) AS step FROM idx) s GROUP BY 1""")
def index_checks(spark, sf):
    return checks.index_checks(I.indices(spark, sf))


@query("merged_checks", """
SELECT 'duplicate_keys' AS "check", 'error' AS level, count(*) AS n_bad FROM (SELECT series, date FROM prices GROUP BY 1, 2 HAVING count(*) > 1) k
UNION ALL SELECT 'series_with_low_coverage', 'warning', count(*) FROM (SELECT p.series FROM prices p
  LEFT JOIN (SELECT date, value FROM idx WHERE "index" = 'vol' AND date < DATE '1997-06-01') i USING (date) GROUP BY 1 HAVING avg((value IS NOT NULL)::INT) < 0.4) s""")
def merged_checks(spark, sf):
    early = I.indices(spark, sf).where((F.col("index") == "vol") & (F.col("date") < "1997-06-01"))
    return checks.merged_checks(joins.merge_index(I.unit_prices(spark, sf), early))


@query("frequency", """
SELECT m.series, n_steps, round(median_step, 6) + 0.0 AS median_step, CASE WHEN CAST(median_step AS INT) BETWEEN 28 AND 31 THEN 'monthly' ELSE 'other' END AS frequency,
  mode_step, kinds > 1 AS has_gaps FROM (
  SELECT series, count(*) AS n_steps, quantile_cont(step::DOUBLE, 0.5) AS median_step, count(DISTINCT step) AS kinds FROM (
    SELECT series, date - lag(date) OVER (PARTITION BY series ORDER BY date) AS step FROM prices) s WHERE step IS NOT NULL GROUP BY 1) m
JOIN (SELECT series, step::INT AS mode_step FROM (SELECT series, step, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, step) AS rn FROM (
    SELECT series, date - lag(date) OVER (PARTITION BY series ORDER BY date) AS step FROM prices) t WHERE step IS NOT NULL GROUP BY 1, 2) u WHERE rn = 1) k
  ON k.series = m.series""")
def frequency(spark, sf):
    return checks.frequency(I.unit_prices(spark, sf))


@query("spike_score", f"""
SELECT {IDX}, round(score, 6) + 0.0 AS spike_score, score > 10 AS spiky FROM (SELECT {IDX},
  max(abs(value)) / (quantile_cont(value, 0.99) - quantile_cont(value, 0.01) + 1e-5) AS score FROM idx GROUP BY 1) s""")
def spike_score(spark, sf):
    return checks.spike_score(I.indices(spark, sf))


# ------------------------------------------------------------------ reshape

_wide_cols = ", ".join(f"max(CASE WHEN series = '{t}' THEN price END) + 0.0 AS \"{t}\"" for t in I.TYPES)


@query("long_to_wide", f"SELECT date, {_wide_cols} FROM prices GROUP BY 1")
def long_to_wide(spark, sf):
    return reshape.to_wide(I.unit_prices(spark, sf), ["date"], "series", "price", I.TYPES)


@query("wide_to_long", "SELECT date, series, price + 0.0 AS price FROM prices WHERE month(date) <> 2")
def wide_to_long(spark, sf):
    """Back to long: text columns are ignored, missing values dropped."""
    wide = long_to_wide(spark, sf).withColumn("note", F.lit("text"))
    holes = wide.withColumns({t: F.when(F.month("date") != 2, F.col(t)) for t in I.TYPES})
    return reshape.to_long(holes)


@query("long_summary", "SELECT count(DISTINCT series) AS n_series, count(*) AS n_obs, min(date) AS date_start, max(date) AS date_end FROM gappy WHERE price IS NOT NULL")
def long_summary(spark, sf):
    return reshape.long_summary(I.gappy_brands(spark, sf).where(F.col("price").isNotNull()))


@query("complete_grid", """
SELECT s.uncertainty, s.scenario, r.regime, v.variable, CAST(x.t AS INTEGER) AS t, f.is_baseline, d.value
FROM (SELECT DISTINCT uncertainty, scenario FROM tidy) s JOIN (SELECT DISTINCT uncertainty, regime FROM tidy) r ON r.uncertainty = s.uncertainty
JOIN (SELECT DISTINCT uncertainty, variable FROM tidy) v ON v.uncertainty = s.uncertainty
JOIN (SELECT uncertainty, unnest(range(min(t), max(t) + 1)) AS t FROM tidy GROUP BY 1) x ON x.uncertainty = s.uncertainty, (VALUES (TRUE), (FALSE)) AS f(is_baseline)
LEFT JOIN tidy d
  ON d.uncertainty = s.uncertainty AND d.scenario = s.scenario AND d.regime = r.regime AND d.variable = v.variable AND d.t = x.t AND d.is_baseline = f.is_baseline""", digits=8)
def complete_grid(spark, sf):
    """Both indices, each with its own regimes, variables and steps."""
    return reshape.complete_grid(I.tidy(spark, sf))


@query("row_bind", "SELECT series, date, price + 0.0 AS price, NULL::DOUBLE AS value FROM prices UNION ALL SELECT \"index\", date, NULL, value + 0.0 FROM idx")
def row_bind(spark, sf):
    return clean.union_all([I.unit_prices(spark, sf).select("series", "date", "price"),
                            I.indices(spark, sf).withColumnRenamed("index", "series")])


@query("lag_rows", """
SELECT series, date, round(price, 6) + 0.0 AS price, round(lag_1, 6) + 0.0 AS lag_1, round(lag_2, 6) + 0.0 AS lag_2, round(lag_3, 6) + 0.0 AS lag_3 FROM (
  SELECT *, lag(price, 1) OVER w AS lag_1, lag(price, 2) OVER w AS lag_2, lag(price, 3) OVER w AS lag_3, row_number() OVER w AS rn
  FROM prices WINDOW w AS (PARTITION BY series ORDER BY date)) s WHERE rn > 3""")
def lag_rows(spark, sf):
    return reshape.add_lags(I.unit_prices(spark, sf), 3, value="price")


# -------------------------------------------------------------------- joins


@query("merge_index", f"SELECT p.series, p.date, p.price + 0.0 AS price, i.value + 0.0 AS value FROM prices p LEFT JOIN (SELECT date, value FROM idx WHERE {IDX} = 'vol') i USING (date)")
def merge_index(spark, sf):
    return joins.merge_index(I.unit_prices(spark, sf), I.indices(spark, sf).where(F.col("index") == "vol"))


@query("match_rate", f"""SELECT count(*) AS n_rows, count(value) AS n_matched, round(100.0 * count(value) / count(*), 2) + 0.0 AS pct_matched
FROM prices p LEFT JOIN (SELECT date, value FROM idx WHERE {IDX} = 'vol') i USING (date)""")
def match_rate(spark, sf):
    return joins.match_rate(merge_index(spark, sf))


@query("merge_all_indices", f"""SELECT p.series, p.date, p.price + 0.0 AS price, a.value + 0.0 AS vol, b.value + 0.0 AS macro FROM prices p
LEFT JOIN (SELECT date, value FROM idx WHERE {IDX} = 'vol') a USING (date) LEFT JOIN (SELECT date, value FROM idx WHERE {IDX} = 'macro') b USING (date)""")
def merge_all_indices(spark, sf):
    return joins.merge_all_indices(I.unit_prices(spark, sf), I.indices(spark, sf), ["vol", "macro"])


@query("baseline_vs_shocked", """SELECT uncertainty, scenario, regime, variable, CAST(t AS INTEGER) AS t, 0.0::DOUBLE AS baseline, value AS shocked,
value AS delta FROM shocked""", digits=8)
def baseline_vs_shocked(spark, sf):
    return joins.baseline_vs_shocked(I.tidy(spark, sf))


# -------------------------------------------------------------- aggregation


def _events(spark, sf) -> DataFrame:
    return readers.read_table(spark, sf, "events").select("event_type", "ts", "value")


_EV = "(SELECT event_type, ts, value FROM events) e"


@query("bucket_mean", f"SELECT event_type, last_day(ts::DATE) AS date, round(avg(value), 6) + 0.0 AS value FROM {_EV} GROUP BY 1, 2")
def bucket_mean(spark, sf):
    """Month means, dated at the end of the month."""
    return aggregate.bucket(_events(spark, sf), ["event_type"], "ts", "value", "mean", anchor="end")


@query("bucket_median", f"SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS date, round(quantile_cont(value, 0.5), 6) + 0.0 AS value FROM {_EV} GROUP BY 1, 2")
def bucket_median(spark, sf):
    """Exact day medians of groups of any size."""
    return aggregate.bucket(_events(spark, sf), ["event_type"], "ts", "value", "median", unit="day")


@query("bucket_first_last", f"""SELECT event_type, date, first + 0.0 AS first, last + 0.0 AS last FROM (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS date,
arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM {_EV} WHERE value IS NOT NULL GROUP BY 1, 2) s""")
def bucket_first_last(spark, sf):
    a = aggregate.bucket(_events(spark, sf), ["event_type"], "ts", "value", "first", unit="week")
    b = aggregate.bucket(_events(spark, sf), ["event_type"], "ts", "value", "last", unit="week")
    return a.withColumnRenamed("value", "first").join(b.withColumnRenamed("value", "last"), ["event_type", "date"])


@query("missingness", """SELECT series, count(*) AS n_total, count(*) - count(price) AS n_missing, round((count(*) - count(price)) / count(*), 4) + 0.0 AS pct_missing,
min(date) AS date_start, max(date) AS date_end, round((count(*) - count(price)) / count(*), 4) > 1 - 0.86 AS low_coverage FROM gappy GROUP BY 1""")
def missingness(spark, sf):
    return aggregate.missingness(I.gappy_brands(spark, sf), coverage=0.86)


@query("date_range", "SELECT min(date) AS start, max(date) AS \"end\", count(date) AS n_obs FROM brands")
def date_range(spark, sf):
    return aggregate.date_range(I.unit_prices(spark, sf, "p_brand"))


@query("missing_cells", "SELECT series, date, bool_or(price IS NULL) AS missing FROM gappy GROUP BY 1, 2")
def missing_cells(spark, sf):
    return aggregate.missing_cells(I.gappy_brands(spark, sf))


@query("column_coverage", f"""WITH m AS (SELECT p.series, p.date, a.value AS vol, CASE WHEN month(p.date) > 3 THEN b.value END AS macro FROM prices p
LEFT JOIN (SELECT date, value FROM idx WHERE {IDX} = 'vol') a USING (date) LEFT JOIN (SELECT date, value FROM idx WHERE {IDX} = 'macro') b USING (date))
SELECT 'vol' AS "column", round(avg((vol IS NOT NULL)::INT), 6) + 0.0 AS coverage FROM m UNION ALL SELECT 'macro', round(avg((macro IS NOT NULL)::INT), 6) + 0.0 FROM m""")
def column_coverage(spark, sf):
    wide = merge_all_indices(spark, sf).withColumn("macro", F.when(F.month("date") > 3, F.col("macro")))
    return aggregate.column_coverage(wide, ["vol", "macro"])


@query("date_means", "SELECT date, count(*) AS n_obs, round(avg(ret), 6) + 0.0 AS ret_mean FROM fret GROUP BY 1")
def date_means(spark, sf):
    return aggregate.date_means(series.log_return(I.unit_prices(spark, sf, "p_brand"), out="ret"))


@query("coverage_table", """SELECT 'Other' AS "group", upper(left(series_id, 1)) || substr(series_id, 2) AS name, series_id, strftime(min(date), '%Y-%m') AS start,
strftime(max(date), '%Y-%m') AS "end", count(*) AS months FROM (SELECT DISTINCT lower(series) AS series_id, date FROM ret WHERE ret IS NOT NULL) s GROUP BY 3""")
def coverage_table(spark, sf):
    """Months per series over two overlapping inputs."""
    ret = I.type_returns(spark, sf).select(F.lower("series").alias("series_id"), "date", "ret")
    return aggregate.coverage_table([ret, ret.where(F.col("date") > "1998-01-01")])


@query("coverage_after_merge", f"""SELECT series, round(avg((value IS NOT NULL)::INT), 6) + 0.0 AS coverage, avg((value IS NOT NULL)::INT) < 0.4 AS low
FROM prices p LEFT JOIN (SELECT date, value FROM idx WHERE {IDX} = 'vol') i USING (date) GROUP BY 1""")
def coverage_after_merge(spark, sf):
    return aggregate.coverage_after_merge(merge_index(spark, sf))


_MOM = """count(*) AS n, round((avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*power(avg(x),3)) / power(var_pop(x), 1.5), 4) + 0.0 AS skewness,
  round((avg(x*x*x*x) - 4*avg(x)*avg(x*x*x) + 6*power(avg(x),2)*avg(x*x) - 3*power(avg(x),4)) / power(var_pop(x), 2), 4) + 0.0 AS kurtosis"""


@query("shape_by_regime", f"""WITH m AS (SELECT {IDX}, avg(value) / 1000 AS mean, quantile_cont(value, 0.5) AS theta FROM idx GROUP BY 1),
s AS (SELECT {IDX}, value / 1000 - mean AS x, value <= theta AS low FROM idx JOIN m USING ({IDX}) WHERE value IS NOT NULL)
SELECT {IDX}, CASE WHEN low THEN 'low' ELSE 'high' END AS regime, {_MOM} FROM s GROUP BY 1, 2 UNION ALL SELECT {IDX}, NULL, {_MOM} FROM s GROUP BY 1""", digits=4)
def shape_by_regime(spark, sf):
    """Each index against its own median."""
    rows = I.indices(spark, sf).withColumn("theta", F.median("value").over(series.whole(["index"])))
    return aggregate.shape_by_regime(rows, "value", F.col("theta"), ["index"])


@query("exact_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 6) + 0.0 AS q01, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS q50,
round(quantile_cont(l_extendedprice, 0.999), 6) + 0.0 AS q999 FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, sf):
    """Exact quantiles of three very large groups."""
    from stratawave.functions.quantiles import exact_quantiles as quantiles

    return quantiles(readers.read_table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.999], ["q01", "q50", "q999"])


@query("quantiles_heavy_tail", """
WITH h AS (SELECT l_linestatus, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END * power(l_extendedprice / 1000, 9) AS x FROM lineitem),
q AS (SELECT l_linestatus, unnest([0.001, 0.25, 0.5, 0.99, 0.9999]) AS prob, unnest([quantile_cont(x, 0.001), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.99),
  quantile_cont(x, 0.9999)]) AS x FROM h GROUP BY 1)
SELECT l_linestatus, prob, round(sign(x) * ln(1 + abs(x)), 6) + 0.0 AS log_value FROM q""")
def quantiles_heavy_tail(spark, sf):
    """Values of both signs over some twenty powers of ten."""
    from stratawave.functions.quantiles import exact_quantiles as quantiles

    lines = readers.read_table(spark, sf, "lineitem").select(
        "l_linestatus", (F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1) * F.pow(F.col("l_extendedprice") / 1000, F.lit(9))).alias("x"))
    probs = [0.001, 0.25, 0.5, 0.99, 0.9999]
    wide = quantiles(lines, ["l_linestatus"], "x", probs, [f"q{i}" for i in range(5)])
    rows = wide.select("l_linestatus", F.inline(F.array(*[F.struct(F.lit(p).alias("prob"), F.col(f"q{i}").alias("x")) for i, p in enumerate(probs)])))
    return rows.select("l_linestatus", "prob", (F.signum("x") * F.log1p(F.abs("x"))).alias("log_value"))


@query("quantiles_equal_values", """SELECT l_returnflag, round(quantile_cont(x, 0.1), 6) + 0.0 AS low, round(quantile_cont(x, 0.5), 6) + 0.0 AS mid, round(quantile_cont(x, 0.9), 6) + 0.0 AS high
FROM (SELECT l_returnflag, CASE WHEN l_extendedprice > 0 THEN 1.5 ELSE l_extendedprice END AS x FROM lineitem) h GROUP BY 1""")
def quantiles_equal_values(spark, sf):
    """Groups whose values are all equal: the buckets' ends solve them."""
    from stratawave.functions.quantiles import exact_quantiles as quantiles

    lines = readers.read_table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_extendedprice") > 0, 1.5).otherwise(F.col("l_extendedprice")).alias("x"))
    return quantiles(lines, ["l_returnflag"], "x", [0.1, 0.5, 0.9], ["low", "mid", "high"])


@query("quantiles_type8", """WITH r AS (SELECT "index", value, row_number() OVER (PARTITION BY "index" ORDER BY value) AS rn, count(*) OVER (PARTITION BY "index") AS n FROM idx WHERE value IS NOT NULL),
p AS (SELECT DISTINCT "index", n, q, (n + 1.0::DOUBLE / 3) * q + 1.0::DOUBLE / 3 AS pos FROM r, (VALUES (0.15::DOUBLE), (0.5::DOUBLE), (0.85::DOUBLE)) AS v(q))
SELECT p."index", p.q AS prob, round(a.value + (pos - floor(pos)) * (b.value - a.value), 6) + 0.0 AS value
FROM p JOIN r a ON a."index" = p."index" AND a.rn = floor(pos) JOIN r b ON b."index" = p."index" AND b.rn = least(floor(pos) + 1, p.n)""")
def quantiles_type8(spark, sf):
    from stratawave.functions.quantiles import grid_quantiles

    probs = [0.15, 0.5, 0.85]
    grid = grid_quantiles(I.indices(spark, sf), ["index"], "value", probs)
    return grid.select("index", F.inline(F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), F.col("grid").alias("value"))))


@query("threshold_percentile", f"SELECT {IDX}, round(avg((x <= theta)::INT), 6) + 0.0 AS percentile FROM driver JOIN theta USING ({IDX}) WHERE x IS NOT NULL GROUP BY 1")
def threshold_percentile(spark, sf):
    rows = I.driver(spark, sf).join(I.thresholds(spark, sf), "index").where(F.col("x").isNotNull())
    return rows.groupBy("index").agg(aggregate.ecdf_at("x", F.col("theta")).alias("percentile"))


# ------------------------------------------------------------ sets, sorting


@query("common_names", "SELECT series FROM prices WHERE date < DATE '1997-01-01' INTERSECT SELECT series FROM prices WHERE date > DATE '1999-01-01' AND series <> 'SMALL'")
def common_names(spark, sf):
    p = I.unit_prices(spark, sf)
    return sets.common_names(p.where(F.col("date") < "1997-01-01"), p.where((F.col("date") > "1999-01-01") & (F.col("series") != "SMALL")), "series")


@query("names_only_in", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment < 'F')")
def names_only_in(spark, sf):
    c = readers.read_table(spark, sf, "customer")
    return sets.names_only_in(c, c.where(F.col("c_mktsegment") < "F"), "c_mktsegment")


@query("ordered_levels", """SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 ELSE 4 END, count(*) DESC, p_type) AS place
FROM part GROUP BY 1""")
def ordered_levels(spark, sf):
    """Sort by category order, then by count."""
    from pyspark.sql import Window as W

    n = readers.read_table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    order = [sets.level_order("p_type", ["SMALL", "MEDIUM", "LARGE"]), F.col("n").desc(), F.col("p_type")]
    return n.withColumn("place", F.row_number().over(W.orderBy(*order))).orderBy(*order)


@query("top_n_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal + 0.0 AS c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) s WHERE rn <= 5")
def top_n_per_group(spark, sf):
    c = readers.read_table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return sets.top_n(c, ["c_mktsegment"], F.col("c_acctbal"), 5, ties=["c_custkey"])


@query("top_n_with_ties", "SELECT p_type, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS rk FROM part) s WHERE rk <= 3")
def top_n_with_ties(spark, sf):
    p = readers.read_table(spark, sf, "part").select("p_type", "p_partkey", "p_size")
    return sets.top_n(p, ["p_type"], F.col("p_size"), 3, with_ties=True)


@query("latest_rows", "SELECT series, date, price + 0.0 AS price FROM prices ORDER BY date DESC, series LIMIT 5")
def latest_rows(spark, sf):
    return sets.head(I.unit_prices(spark, sf), [F.col("date").desc(), F.col("series")], 5)
