"""Driver tables seen as series of readings, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators.clean import clean
from wattline.operators.holidays import fixed_date_holidays
from wattline.operators.resample import resample_mean

VALUES = ("demand_mw", "temp_c", "relative_humidity")

# National holidays with a fixed date.
HOLIDAYS = ((1, 26, "Republic Day"), (8, 15, "Independence Day"), (10, 2, "Gandhi Jayanti"), (12, 25, "Christmas"))
HOLIDAY_YEARS = (1994, 2026)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, series: str = "event_type") -> DataFrame:
    """Events as readings: value is demand, the number in ``props`` stands for weather."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col(series).cast("string").alias("series_id"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("demand_mw"),
        (k * 0.5).alias("temp_c"),
        (100.0 - k).alias("relative_humidity"),
        "event_id",
    )


def series_readings(spark: SparkSession, sf_dir: str, series: str = "event_type") -> DataFrame:
    return readings(spark, sf_dir, series).drop("event_id")


def hourly(spark: SparkSession, sf_dir: str, series: str = "event_type") -> DataFrame:
    return resample_mean(series_readings(spark, sf_dir, series))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(series_readings(spark, sf_dir))


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily readings; price is demand, the day of the key stands for weather."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderdate").alias("datetime"),
        (F.col("o_totalprice") / 50.0).alias("demand_mw"),
        (F.col("o_custkey") % 45).cast("double").alias("temp_c"),
        (F.col("o_orderkey") % 100).cast("double").alias("relative_humidity"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on a dense, cleaned daily grid."""
    return clean(order_readings(spark, sf_dir), freq="day")


def ship_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings over seven years."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"),
        F.col("l_shipdate").alias("datetime"),
        F.col("l_extendedprice").alias("demand_mw"),
    )


def mixed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one series of seven years and, since 2001, the returned ones as a short series."""
    late = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= "2001-01-01")
    return table(spark, sf_dir, "lineitem").select(
        F.when(late, "late").otherwise("all").alias("series_id"),
        F.col("l_shipdate").alias("datetime"),
        (F.col("l_extendedprice") / 10.0).alias("demand_mw"),
        (F.col("l_partkey") % 45).cast("double").alias("temp_c"),
        (F.col("l_orderkey") % 100).cast("double").alias("relative_humidity"),
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both on a cleaned hourly grid: the long one has annual lags, the short one has not."""
    return clean(mixed_readings(spark, sf_dir))


def holidays(spark: SparkSession) -> DataFrame:
    return fixed_date_holidays(spark, *HOLIDAY_YEARS, HOLIDAYS, "IN")


# --- the same views in SQL ---------------------------------------------------------

_K = "CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)"


def readings_sql(series: str = "event_type") -> str:
    return f"""readings AS (
  SELECT CAST({series} AS VARCHAR) AS series_id, ts AS datetime, value AS demand_mw,
         {_K} * 0.5 AS temp_c, 100.0 - {_K} AS relative_humidity, event_id
  FROM events)"""


ORDERS_SQL = """readings AS (
  SELECT o_orderpriority AS series_id, o_orderdate AS datetime, o_totalprice / 50.0 AS demand_mw,
         CAST(o_custkey % 45 AS DOUBLE) AS temp_c, CAST(o_orderkey % 100 AS DOUBLE) AS relative_humidity
  FROM orders)"""

MIXED_SQL = """readings AS (
  SELECT CASE WHEN l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2001-01-01' THEN 'late' ELSE 'all' END AS series_id,
         l_shipdate AS datetime, l_extendedprice / 10.0 AS demand_mw,
         CAST(l_partkey % 45 AS DOUBLE) AS temp_c, CAST(l_orderkey % 100 AS DOUBLE) AS relative_humidity
  FROM lineitem)"""

SHIP_SQL = """readings AS (
  SELECT l_returnflag AS series_id, l_shipdate AS datetime, l_extendedprice AS demand_mw FROM lineitem)"""


def grid_sql(unit: str = "hour", values: Sequence[str] = VALUES, source: str = "readings", name: str = "grid") -> str:
    """Dense grid of means with its step number ``i``."""
    means = ", ".join(f"avg({v}) AS {v}" for v in values)
    columns = ", ".join(f"a.{v}" for v in values)
    return f"""{name}_agg AS (
  SELECT series_id, CAST(date_trunc('{unit}', datetime) AS TIMESTAMP) AS datetime, {means}
  FROM {source} GROUP BY 1, 2),
{name}_steps AS (
  SELECT series_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 {unit})) AS datetime
  FROM {name}_agg GROUP BY series_id),
{name} AS (
  SELECT s.series_id, s.datetime, {columns},
         row_number() OVER (PARTITION BY s.series_id ORDER BY s.datetime) AS i
  FROM {name}_steps s LEFT JOIN {name}_agg a ON s.series_id = a.series_id AND s.datetime = a.datetime)"""


def clip_sql(source: str = "grid", name: str = "clipped", values: Sequence[str] = VALUES) -> str:
    others = "".join(f", g.{v}" for v in values if v != "demand_mw")
    return f"""{name}_q AS (
  SELECT series_id, count(demand_mw) AS n, quantile_cont(demand_mw, 0.25) AS q25, quantile_cont(demand_mw, 0.75) AS q75,
         quantile_cont(demand_mw, 0.001) AS q_low, quantile_cont(demand_mw, 0.999) AS q_high
  FROM {source} GROUP BY series_id),
{name}_fences AS (
  SELECT series_id,
         CASE WHEN n > 10 THEN greatest(0.0, q25 - 3.5 * (q75 - q25)) ELSE q_low END AS lower,
         CASE WHEN n > 10 THEN q75 + 3.5 * (q75 - q25) ELSE q_high END AS upper
  FROM {name}_q),
{name} AS (
  SELECT g.series_id, g.datetime,
         CASE WHEN g.demand_mw IS NOT NULL THEN greatest(least(g.demand_mw, f.upper), f.lower) END AS demand_mw{others}, g.i
  FROM {source} g JOIN {name}_fences f ON g.series_id = f.series_id)"""


def neighbours_sql(values: Sequence[str], source: str, name: str = "near") -> str:
    """Value and step of the readings around each step: p_ and ps_ before, n_ and ns_ after."""
    parts = []
    for v in values:
        at = f"CASE WHEN {v} IS NOT NULL THEN i END"
        parts += [
            f"last_value({v} IGNORE NULLS) OVER up AS p_{v}",
            f"last_value({at} IGNORE NULLS) OVER up AS ps_{v}",
            f"first_value({v} IGNORE NULLS) OVER down AS n_{v}",
            f"first_value({at} IGNORE NULLS) OVER down AS ns_{v}",
        ]
    return f"""{name} AS (
  SELECT *, {", ".join(parts)}
  FROM {source}
  WINDOW up AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def chain_sql(v: str) -> str:
    return f"""CASE WHEN {v} IS NOT NULL THEN {v}
       WHEN p_{v} IS NULL THEN n_{v}
       WHEN i - ps_{v} <= 4 OR n_{v} IS NULL THEN p_{v}
       ELSE p_{v} + (n_{v} - p_{v}) * (i - ps_{v} - 4) / (ns_{v} - ps_{v} - 4) END AS {v}"""


def filled_sql(values: Sequence[str] = VALUES, source: str = "clipped", name: str = "cleaned") -> str:
    filled = ", ".join(chain_sql(v) for v in values)
    return f"""{neighbours_sql(values, source, name + "_near")},
{name} AS (SELECT series_id, datetime, {filled}, i FROM {name}_near)"""


def clean_sql(source: str = "", unit: str = "hour", values: Sequence[str] = VALUES, name: str = "cleaned") -> str:
    """Everything from readings to the cleaned grid ``name``."""
    return ",\n".join(
        [source or readings_sql(), grid_sql(unit, values), clip_sql(values=values), filled_sql(values, name=name)]
    )


def holidays_sql() -> str:
    dates = ", ".join(
        f"make_date(y, {m}, {d})" for m, d, _ in HOLIDAYS
    )
    return f"""holidays AS (
  SELECT unnest([{dates}]) AS holiday_date FROM (SELECT unnest(generate_series({HOLIDAY_YEARS[0]}, {HOLIDAY_YEARS[1]})) AS y))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
