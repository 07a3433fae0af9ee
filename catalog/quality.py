"""Data-quality checks and cleaning."""

from __future__ import annotations

from functools import reduce

from catalog import views as V
from catalog.registry import query
from pyspark.sql import functions as F
from wattline.operators import clean as C
from wattline.operators import quality as Q
from wattline.operators.resample import resample_daily_first, resample_daily_mean

# Limits that some readings of the driver tables break.
BOUNDS = Q.Bounds(min_demand_mw=0.5, max_demand_mw=200.0, min_temp_c=1.0, max_temp_c=48.0, min_humidity=2.0, max_humidity=99.0)
_R = V.with_(V.readings_sql())


def _tables(spark, sf_dir):
    """A good table, one without the target, one without both columns, and one whose times are texts."""
    good = V.readings(spark, sf_dir)
    return {
        "readings": good,
        "no target": good.drop("demand_mw"),
        "orders": V.table(spark, sf_dir, "orders"),
        "texts": good.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")),
    }


def _verdicts(spark, sf_dir):
    reports = [Q.schema_report(df).withColumn("name", F.lit(name)) for name, df in _tables(spark, sf_dir).items()]
    return reduce(lambda a, b: a.unionByName(b), reports)


_VERDICT_SQL = _R + """, n AS (SELECT count(*) AS n_rows FROM readings), o AS (SELECT count(*) AS n_rows FROM orders), verdicts AS (
  SELECT 'readings' AS name, n_rows, true AS valid, true AS timed, CAST(NULL AS VARCHAR) AS problem FROM n
  UNION ALL SELECT 'no target', n_rows, false, true, 'data set is missing the target column ''demand_mw''' FROM n
  UNION ALL SELECT 'orders', n_rows, false, false, 'data set has no time column ''datetime''' FROM o
  UNION ALL SELECT 'texts', n_rows, true, false, '''datetime'' must be a timestamp column' FROM n)"""


@query("validate_schema", _VERDICT_SQL + " SELECT name, n_rows, valid, problem FROM verdicts")
def validate_schema(spark, sf_dir):
    """Verdicts on good and bad tables."""
    return _verdicts(spark, sf_dir).select("name", "n_rows", "valid", "problem")


@query("dq_index_type", _VERDICT_SQL + " SELECT name, n_rows, timed FROM verdicts")
def dq_index_type(spark, sf_dir):
    """Whether the time column of good and bad tables is a timestamp."""
    return _verdicts(spark, sf_dir).select("name", "n_rows", "timed")


@query("dq_extent", _R + "SELECT series_id, count(*) AS total_rows, min(datetime) AS start_time, max(datetime) AS end_time FROM readings GROUP BY series_id")
def dq_extent(spark, sf_dir):
    return Q.extent(V.readings(spark, sf_dir))


_OUT_OF_ORDER = """SELECT series_id, CAST(sum(CASE WHEN before > datetime THEN 1 ELSE 0 END) AS BIGINT) AS n_out_of_order
FROM (SELECT *, lag(datetime) OVER (PARTITION BY series_id ORDER BY o_orderkey) AS before
      FROM (SELECT o_orderpriority AS series_id, o_orderdate AS datetime, o_orderkey FROM orders))
GROUP BY series_id"""


@query("dq_monotonic", _OUT_OF_ORDER)
def dq_monotonic(spark, sf_dir):
    """Orders in the order of their keys."""
    orders = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("datetime"), "o_orderkey"
    )
    return Q.count_out_of_order(orders, "o_orderkey")


@query("dq_duplicates", V.with_(V.ORDERS_SQL) + """SELECT series_id, CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT series_id, datetime, count(*) AS n FROM readings GROUP BY 1, 2) GROUP BY series_id""")
def dq_duplicates(spark, sf_dir):
    return Q.count_duplicates(V.order_readings(spark, sf_dir))


@query("dq_nulls", V.with_(V.readings_sql("user_id"), V.grid_sql()) + """SELECT series_id, count(*) - count(demand_mw) AS null_demand_mw,
  count(*) - count(temp_c) AS null_temp_c, count(*) - count(relative_humidity) AS null_relative_humidity
FROM grid GROUP BY series_id""")
def dq_nulls(spark, sf_dir):
    return Q.count_nulls(V.hourly(spark, sf_dir, "user_id"))


@query("dq_demand_low", _R + "SELECT series_id, count(*) FILTER (demand_mw <= 0.5) AS n_low, min(demand_mw) AS demand_min FROM readings GROUP BY series_id")
def dq_demand_low(spark, sf_dir):
    return Q.count_demand_low(V.readings(spark, sf_dir), BOUNDS)


@query("dq_demand_high", _R + "SELECT series_id, count(*) FILTER (demand_mw > 200) AS n_high, max(demand_mw) AS demand_max FROM readings GROUP BY series_id")
def dq_demand_high(spark, sf_dir):
    return Q.count_demand_high(V.readings(spark, sf_dir), BOUNDS)


@query("dq_temp_bounds", _R + """SELECT series_id, count(*) FILTER (temp_c < 1 OR temp_c > 48) AS n_temp_outside,
  min(temp_c) AS temp_min, max(temp_c) AS temp_max FROM readings GROUP BY series_id""")
def dq_temp_bounds(spark, sf_dir):
    return Q.count_temp_outside(V.readings(spark, sf_dir), BOUNDS)


@query("dq_humidity_bounds", _R + """SELECT series_id, count(*) FILTER (relative_humidity < 2 OR relative_humidity > 99) AS n_humidity_outside,
  min(relative_humidity) AS humidity_min, max(relative_humidity) AS humidity_max FROM readings GROUP BY series_id""")
def dq_humidity_bounds(spark, sf_dir):
    return Q.count_humidity_outside(V.readings(spark, sf_dir), BOUNDS)


@query("dq_report", _R + """, counts AS (
  SELECT series_id, count(*) AS total_rows, min(datetime) AS start_time, max(datetime) AS end_time,
    count(*) - count(DISTINCT datetime) AS n_duplicates,
    count(*) FILTER (demand_mw <= 0.5) AS n_low, count(*) FILTER (demand_mw > 200) AS n_high,
    count(*) FILTER (temp_c < 1 OR temp_c > 48) AS n_temp_outside,
    count(*) FILTER (relative_humidity < 2 OR relative_humidity > 99) AS n_humidity_outside
  FROM readings GROUP BY series_id)
SELECT *, (CASE WHEN n_duplicates > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_low > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_high > 0 THEN 1 ELSE 0 END)
  + (CASE WHEN n_temp_outside > 0 THEN 1 ELSE 0 END) + (CASE WHEN n_humidity_outside > 0 THEN 1 ELSE 0 END) AS n_issues,
  n_duplicates + n_low + n_high + n_temp_outside + n_humidity_outside = 0 AS passed
FROM counts""")
def dq_report(spark, sf_dir):
    report = Q.quality_report(V.readings(spark, sf_dir), BOUNDS, seq="event_id")
    return report.select(
        "series_id", "total_rows", "start_time", "end_time", "n_duplicates", "n_low", "n_high", "n_temp_outside",
        "n_humidity_outside", F.size("issues").alias("n_issues"), "passed",
    )


@query("clean_index_check", _R + """SELECT 'readings' AS name, true AS accepted, count(DISTINCT series_id) AS n_series FROM readings
UNION ALL SELECT 'texts', false, 0""")
def clean_index_check(spark, sf_dir):
    """Series of a table that cleaning accepts, and of one that it refuses."""
    tables = _tables(spark, sf_dir)
    parts = []
    for name in ("readings", "texts"):
        accepted = C.has_time_column(tables[name])
        grid = C.clean(tables[name]) if accepted else tables[name].limit(0)
        parts.append(grid.agg(F.lit(name).alias("name"), F.lit(accepted).alias("accepted"), F.count_distinct("series_id").alias("n_series")))
    return parts[0].unionByName(parts[1])


_ALL = "SELECT series_id, datetime, demand_mw, temp_c, relative_humidity FROM"
_DOUBLES = "demand_mw temp_c relative_humidity"
_USERS = V.with_(V.readings_sql("user_id"), V.grid_sql())


@query("resample_hourly_mean", _USERS + f"{_ALL} grid", _DOUBLES)
def resample_hourly_mean(spark, sf_dir):
    return V.hourly(spark, sf_dir, "user_id")


@query("iqr_bounds", V.with_(V.readings_sql(), V.grid_sql()) + """SELECT series_id, count(demand_mw) AS n_values,
  quantile_cont(demand_mw, 0.25) AS q25, quantile_cont(demand_mw, 0.75) AS q75,
  greatest(0.0, quantile_cont(demand_mw, 0.25) - 3.5 * (quantile_cont(demand_mw, 0.75) - quantile_cont(demand_mw, 0.25))) AS lower,
  quantile_cont(demand_mw, 0.75) + 3.5 * (quantile_cont(demand_mw, 0.75) - quantile_cont(demand_mw, 0.25)) AS upper
FROM grid GROUP BY series_id""", "q25 q75 lower upper")
def iqr_bounds(spark, sf_dir):
    return C.outlier_bounds(V.hourly(spark, sf_dir), mode="iqr")


@query("iqr_bounds_readings", _R + """SELECT series_id, count(demand_mw) AS n_values, quantile_cont(demand_mw, 0.25) AS q25, quantile_cont(demand_mw, 0.75) AS q75,
  greatest(0.0, quantile_cont(demand_mw, 0.25) - 3.5 * (quantile_cont(demand_mw, 0.75) - quantile_cont(demand_mw, 0.25))) AS lower,
  quantile_cont(demand_mw, 0.75) + 3.5 * (quantile_cont(demand_mw, 0.75) - quantile_cont(demand_mw, 0.25)) AS upper
FROM readings GROUP BY series_id""", "q25 q75 lower upper")
def iqr_bounds_readings(spark, sf_dir):
    """Fences of raw readings, which a series may have any number of."""
    return C.outlier_bounds(V.series_readings(spark, sf_dir), mode="iqr", selection="histogram")


@query("clip_iqr", _USERS + ", " + V.clip_sql() + f" {_ALL} clipped", _DOUBLES)
def clip_iqr(spark, sf_dir):
    return C.clip_outliers(V.hourly(spark, sf_dir, "user_id"))


@query("clip_quantile", V.with_(V.readings_sql(), V.grid_sql()) + """, q AS (
  SELECT series_id, quantile_cont(demand_mw, 0.001) AS lo, quantile_cont(demand_mw, 0.999) AS hi FROM grid GROUP BY series_id)
SELECT g.series_id, datetime, CASE WHEN demand_mw IS NOT NULL THEN greatest(least(demand_mw, hi), lo) END AS demand_mw, temp_c, relative_humidity
FROM grid g JOIN q ON g.series_id = q.series_id""", _DOUBLES)
def clip_quantile(spark, sf_dir):
    return C.clip_outliers(V.hourly(spark, sf_dir), mode="quantile")


_NEAR = _USERS + ", " + V.neighbours_sql(V.VALUES, "grid") + " "


@query("ffill_limited", _NEAR + """SELECT series_id, datetime,
  CASE WHEN demand_mw IS NULL AND i - ps_demand_mw <= 4 THEN p_demand_mw ELSE demand_mw END AS demand_mw, temp_c, relative_humidity FROM near""", _DOUBLES)
def ffill_limited(spark, sf_dir):
    return C.ffill(V.hourly(spark, sf_dir, "user_id"))


@query("interpolate_linear", _NEAR + """SELECT series_id, datetime,
  CASE WHEN demand_mw IS NOT NULL THEN demand_mw WHEN ns_demand_mw IS NULL THEN p_demand_mw
       ELSE p_demand_mw + (n_demand_mw - p_demand_mw) * (i - ps_demand_mw) / (ns_demand_mw - ps_demand_mw) END AS demand_mw,
  temp_c, relative_humidity FROM near""", _DOUBLES)
def interpolate_linear(spark, sf_dir):
    return C.interpolate_linear(V.hourly(spark, sf_dir, "user_id"))


@query("bfill", _NEAR + "SELECT series_id, datetime, coalesce(demand_mw, n_demand_mw) AS demand_mw, temp_c, relative_humidity FROM near", _DOUBLES)
def bfill(spark, sf_dir):
    return C.bfill(V.hourly(spark, sf_dir, "user_id"))


@query("impute_weather", _NEAR + f"SELECT series_id, datetime, demand_mw, {V.chain_sql('temp_c')}, {V.chain_sql('relative_humidity')} FROM near", _DOUBLES)
def impute_weather(spark, sf_dir):
    return C.fill_gaps(V.hourly(spark, sf_dir, "user_id"), ["temp_c", "relative_humidity"])


@query("fill_residual", _NEAR + "SELECT series_id, datetime, " + ", ".join(f"coalesce({v}, n_{v}, p_{v}) AS {v}" for v in V.VALUES) + " FROM near", _DOUBLES)
def fill_residual(spark, sf_dir):
    return C.fill_residual(V.hourly(spark, sf_dir, "user_id"), V.VALUES)


@query("clean", V.with_(V.clean_sql(V.readings_sql("user_id"))) + f"{_ALL} cleaned", _DOUBLES)
def clean(spark, sf_dir):
    """Resample, clip and fill in one pass, 150 series per scale step."""
    return C.clean(V.series_readings(spark, sf_dir, "user_id"))


@query("resample_daily_mean", V.with_(V.ORDERS_SQL, V.grid_sql("day")) + f"{_ALL} grid", _DOUBLES)
def daily_mean(spark, sf_dir):
    return resample_daily_mean(V.order_readings(spark, sf_dir))


@query("resample_daily_first", """WITH readings AS (SELECT CAST(user_id AS VARCHAR) AS series_id, ts AS datetime, event_id,
    CASE WHEN event_type <> 'error' THEN event_type END AS weather_source FROM events),
firsts AS (SELECT series_id, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS datetime,
    arg_min(weather_source, datetime) FILTER (weather_source IS NOT NULL) AS weather_source FROM readings GROUP BY 1, 2),
days AS (SELECT series_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 DAY)) AS datetime FROM firsts GROUP BY 1)
SELECT d.series_id, d.datetime, f.weather_source FROM days d LEFT JOIN firsts f ON d.series_id = f.series_id AND d.datetime = f.datetime""")
def daily_first(spark, sf_dir):
    """First event type of each user and day that is not an error."""
    events = V.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("series_id"),
        F.col("ts").alias("datetime"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("weather_source"),
    )
    return resample_daily_first(events)


_BROKEN = V.with_(V.readings_sql()) + """, broken AS (
  SELECT CASE WHEN event_id % 11 <> 0 THEN series_id END AS series_id, datetime - CASE WHEN event_id % 13 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS datetime,
    CASE WHEN event_id % 17 = 0 THEN -5.0 WHEN event_id % 19 <> 0 THEN demand_mw END AS demand_mw, event_id FROM readings),
arrived AS (SELECT *, lag(datetime) OVER (PARTITION BY series_id ORDER BY event_id) > datetime AS back FROM broken),
times AS (SELECT series_id, datetime, count(*) AS n FROM broken GROUP BY 1, 2),
twice AS (SELECT series_id, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM times GROUP BY 1),
counts AS (SELECT series_id, count(*) AS total_rows, count(*) FILTER (back) AS n_out_of_order, count(*) FILTER (demand_mw IS NULL) AS null_demand_mw,
  count(*) FILTER (demand_mw <= 0) AS n_low, min(demand_mw) AS low FROM arrived GROUP BY 1)
"""


@query("dq_report_broken", _BROKEN + """SELECT c.series_id, total_rows, n_out_of_order, null_demand_mw, n_low, n_duplicates, list_filter([
    CASE WHEN n_out_of_order > 0 THEN 'timestamps are not monotonically increasing' END,
    CASE WHEN n_duplicates > 0 THEN n_duplicates || ' duplicate timestamps' END,
    CASE WHEN null_demand_mw > 0 THEN 'unresolved missing values in columns: demand_mw' END,
    CASE WHEN n_low > 0 THEN n_low || ' non-positive or negative demand values (min=' || printf('%.1f', low) || ')' END], lambda x: x IS NOT NULL) AS issues
  FROM counts c JOIN twice t ON c.series_id IS NOT DISTINCT FROM t.series_id""")
def dq_report_broken(spark, sf_dir):
    """All rules on readings that break them, arrival order and readings without a series included."""
    k = F.col("event_id")
    broken = V.readings(spark, sf_dir).select(
        F.when(k % 11 != 0, F.col("series_id")).alias("series_id"),
        (F.col("datetime") - F.make_dt_interval(days=F.when(k % 13 == 0, 1).otherwise(0))).alias("datetime"),
        F.when(k % 17 == 0, -5.0).when(k % 19 != 0, F.col("demand_mw")).alias("demand_mw"),
        "event_id",
    )
    report = Q.quality_report(broken, seq="event_id")
    return report.select("series_id", "total_rows", "n_out_of_order", "null_demand_mw", "n_low", "n_duplicates", "issues")
