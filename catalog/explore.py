"""Profiles, statistics, autocorrelation and decomposition."""

from __future__ import annotations

from catalog import views as V
from catalog.features import lag_sql
from catalog.registry import query, scratch
from pyspark.sql import functions as F
from wattline.operators import explore as E
from wattline.operators import loess as L
from wattline.sources.files import read_table, write_table

_HOURLY = V.with_(V.clean_sql())
_DAILY = V.with_(V.clean_sql(V.ORDERS_SQL, "day"))


@query("recent_window", _HOURLY + "SELECT series_id, datetime, demand_mw FROM cleaned QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) <= 48", "demand_mw")
def recent_window(spark, sf_dir):
    return E.recent_window(V.cleaned(spark, sf_dir), 48).select("series_id", "datetime", "demand_mw")


def _profile(name: str, prefix: str, build, column: str, part: str, freq: str):
    @query(name, prefix + f"SELECT series_id, CAST({part} AS INTEGER) AS {column}, avg(demand_mw) AS mean_mw FROM cleaned GROUP BY 1, 2", "mean_mw")
    def run(spark, sf_dir):
        return build(V.cleaned(spark, sf_dir) if freq == "hour" else V.daily(spark, sf_dir))


_profile("profile_hour", _HOURLY, E.profile_hour, "hour", "hour(datetime)", "hour")
_profile("profile_dow", _DAILY, E.profile_day_of_week, "day_of_week", "isodow(datetime) - 1", "day")
_profile("profile_month", _DAILY, E.profile_month, "month", "month(datetime)", "day")


@query("week_zoom", _DAILY + """, ends AS (SELECT series_id, max(i) AS n FROM cleaned GROUP BY 1)
SELECT c.series_id, datetime, demand_mw FROM cleaned c JOIN ends e ON c.series_id = e.series_id WHERE i BETWEEN n - 1439 AND n - 1439 + 7""", "demand_mw")
def week_zoom(spark, sf_dir):
    return E.week_zoom(V.daily(spark, sf_dir), freq="day").select("series_id", "datetime", "demand_mw")


@query("summary_stats", _HOURLY + """SELECT series_id, min(datetime) AS start_time, max(datetime) AS end_time, count(*) AS n_rows, avg(demand_mw) AS demand_mean,
  stddev_samp(demand_mw) AS demand_std, min(temp_c) AS temp_min, max(temp_c) AS temp_max FROM cleaned GROUP BY series_id""", "demand_mean demand_std temp_min temp_max")
def summary_stats(spark, sf_dir):
    return E.summary_stats(V.cleaned(spark, sf_dir))


@query("weather_demand_scatter", _HOURLY + "SELECT series_id, temp_c, relative_humidity, demand_mw FROM cleaned", "temp_c relative_humidity demand_mw")
def weather_demand_scatter(spark, sf_dir):
    return E.weather_demand_pairs(V.cleaned(spark, sf_dir))


@query("weather_demand_correlation", _HOURLY + "SELECT series_id, corr(temp_c, demand_mw) AS temp_corr, corr(relative_humidity, demand_mw) AS humidity_corr FROM cleaned GROUP BY series_id", "temp_corr humidity_corr")
def weather_demand_correlation(spark, sf_dir):
    return E.weather_demand_correlation(V.cleaned(spark, sf_dir))


_ACF_SQL = V.clean_sql() + """, centred AS (SELECT series_id, i, demand_mw - avg(demand_mw) OVER (PARTITION BY series_id) AS x FROM cleaned),
total AS (SELECT series_id, sum(x * x) AS t FROM centred GROUP BY 1),
pairs AS (SELECT a.series_id, a.i - b.i AS lag, sum(a.x * b.x) AS s FROM centred a JOIN centred b ON a.series_id = b.series_id AND a.i - b.i BETWEEN 0 AND 48 GROUP BY 1, 2),
acf AS (SELECT p.series_id, CAST(lag AS INTEGER) AS lag, s / t AS acf FROM pairs p JOIN total USING (series_id))"""


@query("acf", "WITH " + _ACF_SQL + " SELECT * FROM acf", "acf")
def acf(spark, sf_dir):
    return E.acf(V.cleaned(spark, sf_dir))


# Durbin-Levinson: phi holds the coefficients of the order before, r the autocorrelations from lag 1 on.
_PACF_SQL = "WITH RECURSIVE " + _ACF_SQL + """,
lists AS (SELECT series_id, list(acf ORDER BY lag) FILTER (lag > 0) AS r FROM acf GROUP BY 1),
steps AS (
  SELECT series_id, r, 1 AS lag, [r[1]] AS phi, r[1] AS pacf FROM lists
  UNION ALL
  SELECT series_id, r, lag + 1, list_append(list_transform(generate_series(1, lag), lambda j: phi[j] - last * phi[lag - j + 1]), last), last
  FROM (SELECT *, (r[lag + 1] - list_dot_product(phi, list_reverse(r[1:lag]))) / (1 - list_dot_product(phi, r[1:lag])) AS last FROM steps WHERE lag < 48))
SELECT series_id, 0 AS lag, 1.0 AS pacf FROM lists UNION ALL SELECT series_id, lag, pacf FROM steps"""


@query("pacf", _PACF_SQL, "pacf")
def pacf(spark, sf_dir):
    return E.pacf(E.acf(V.cleaned(spark, sf_dir)))


_TREND = """CASE WHEN count(demand_mw) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN
  (sum(demand_mw) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)
   + ({0} + lead(demand_mw, 12) OVER (PARTITION BY series_id ORDER BY i)) / 2) / 24 END""".format(lag_sql("demand_mw", 12))


@query("seasonal_decompose", _HOURLY + f""", trended AS (SELECT series_id, datetime, demand_mw, hour(datetime) AS phase, {_TREND} AS trend FROM cleaned),
phases AS (SELECT series_id, phase, avg(demand_mw - trend) AS m FROM trended GROUP BY 1, 2),
seasons AS (SELECT series_id, phase, m - avg(m) OVER (PARTITION BY series_id) AS seasonal FROM phases)
SELECT t.series_id, datetime, demand_mw, trend, seasonal, demand_mw - trend - seasonal AS resid
FROM trended t JOIN seasons s ON t.series_id = s.series_id AND t.phase = s.phase""", "demand_mw trend seasonal resid")
def seasonal_decompose(spark, sf_dir):
    return E.seasonal_decompose(V.cleaned(spark, sf_dir))


@query("stl_decompose", _HOURLY + " SELECT series_id, datetime, demand_mw, true AS adds_up, true AS explains FROM cleaned", "demand_mw")
def stl_decompose(spark, sf_dir):
    """Loess decomposition: the parts add up to the value, and the remainder varies less than the value."""
    parts = read_table(spark, write_table(L.stl_decompose(V.cleaned(spark, sf_dir)), scratch(spark)))
    adds_up = F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("demand_mw")) < 1e-6
    explains = parts.groupBy("series_id").agg((F.var_pop("resid") < F.var_pop("demand_mw")).alias("explains"))
    return parts.join(explains, "series_id").select("series_id", "datetime", "demand_mw", adds_up.alias("adds_up"), "explains")
