"""Weather expressions and weather of the forecast horizon."""

from __future__ import annotations

from catalog import views as V
from catalog.features import DERIVED_SQL, weather_window_sql
from catalog.registry import query
from pyspark.sql import functions as F
from wattline.functions.weather import Climatology
from wattline.operators import features as X
from wattline.operators import horizon as H

_R = V.with_(V.readings_sql())
_KEYS = "event_id, series_id, datetime"


def _derived(name: str, columns: list[str]):
    sql = _R + f"SELECT {_KEYS}, " + ", ".join(f"{DERIVED_SQL[c]} AS {c}" for c in columns) + " FROM readings"

    @query(name, sql, " ".join(columns))
    def run(spark, sf_dir):
        return X.add_derived_weather(V.readings(spark, sf_dir)).select(*_KEYS.split(", "), *columns)


_derived("wx_degree_days", ["cdd", "hdd", "cdd_sq"])
_derived("wx_heat_index", ["heat_index_c"])
_derived("wx_temp_humidity", ["temp_humidity_interaction"])


def _features(name: str, freq: str):
    prefix = V.with_(V.clean_sql()) if freq == "hour" else V.with_(V.clean_sql(V.ORDERS_SQL, "day"))
    columns = DERIVED_SQL | weather_window_sql(X.SPECS[freq])
    sql = prefix + "SELECT series_id, datetime, " + ", ".join(f"{c} AS {n}" for n, c in columns.items()) + " FROM cleaned"

    @query(name, sql, " ".join(columns))
    def run(spark, sf_dir):
        grid = V.cleaned(spark, sf_dir) if freq == "hour" else V.daily(spark, sf_dir)
        return X.add_weather_features(grid, freq=freq).select("series_id", "datetime", *columns)


_features("wx_features", "hour")
_features("wx_features_daily", "day")

# --- climatology -------------------------------------------------------------------

_TEMP = "(26.5 + 11.5 * sin(2 * pi() * (dayofyear(datetime) - 59) / 365.25) + 4.5 * sin(2 * pi() * (hour(datetime) - 9) / 24.0))"
_HUM = f"(82.0 - 1.25 * {_TEMP} + CASE WHEN dayofyear(datetime) BETWEEN 180 AND 270 THEN 22.0 ELSE 0.0 END)"
CLIM_TEMP_SQL = f"round({_TEMP}, 2)"
CLIM_HUM_SQL = f"round(least(greatest({_HUM}, 15.0), 98.0), 2)"


@query("wx_climatology", V.with_(V.SHIP_SQL) + f"SELECT DISTINCT datetime, {CLIM_TEMP_SQL} AS temp_c, {CLIM_HUM_SQL} AS relative_humidity FROM readings")
def wx_climatology(spark, sf_dir):
    """Profile of every distinct ship date."""
    t = F.col("datetime")
    days = V.ship_readings(spark, sf_dir).select("datetime").distinct()
    return days.withColumns({"temp_c": Climatology().temp(t), "relative_humidity": Climatology().humidity(t)})


# --- horizon -----------------------------------------------------------------------

HORIZON = 20 * 24

FUTURE_SQL = V.with_(V.readings_sql(), V.grid_sql()) + f""", future AS (
  SELECT series_id, step, CAST(hi + step * INTERVAL 1 HOUR AS TIMESTAMP) AS datetime
  FROM (SELECT series_id, max(datetime) AS hi FROM grid GROUP BY 1), (SELECT CAST(unnest(generate_series(1, {HORIZON})) AS INTEGER) AS step)),
forecast AS (SELECT series_id, CAST(datetime + INTERVAL 30 DAY AS TIMESTAMP) AS datetime, temp_c, relative_humidity FROM grid)"""


def future(spark, sf_dir):
    return H.future_grid(V.hourly(spark, sf_dir), HORIZON)


def weather_forecast(spark, sf_dir):
    """Weather of the covered month, moved 30 days ahead, stands for a forecast."""
    ahead = F.col("datetime") + F.make_dt_interval(days=F.lit(30))
    return V.hourly(spark, sf_dir).select("series_id", ahead.alias("datetime"), "temp_c", "relative_humidity")


@query("wx_horizon_fill", FUTURE_SQL + f""", joined AS (
  SELECT u.series_id, u.step, u.datetime, f.temp_c IS NOT NULL AND u.step <= 336 AS used, f.temp_c, f.relative_humidity
  FROM future u LEFT JOIN forecast f ON u.series_id = f.series_id AND u.datetime = f.datetime)
SELECT series_id, step, datetime, CASE WHEN used THEN temp_c ELSE {CLIM_TEMP_SQL} END AS temp_c,
  CASE WHEN used THEN relative_humidity ELSE {CLIM_HUM_SQL} END AS relative_humidity,
  CASE WHEN used THEN 'nwp_forecast' ELSE 'climatology' END AS weather_source FROM joined""", "temp_c relative_humidity")
def wx_horizon_fill(spark, sf_dir):
    return H.weather_for_horizon(future(spark, sf_dir), weather_forecast(spark, sf_dir), on=["series_id"])


@query("wx_horizon_cap", FUTURE_SQL + "SELECT * FROM forecast WHERE datetime < TIMESTAMP '2024-01-31' + INTERVAL 14 DAY", "temp_c relative_humidity")
def wx_horizon_cap(spark, sf_dir):
    return H.limit_weather_forecast(weather_forecast(spark, sf_dir), F.lit("2024-01-31 00:00:00"))


@query("wx_scenario_delta", FUTURE_SQL + f"""SELECT series_id, step, datetime, CAST(scenario_id AS INTEGER) AS scenario_id, -5.0 + 0.5 * scenario_id AS temp_delta,
  {CLIM_TEMP_SQL} + (-5.0 + 0.5 * scenario_id) AS temp_c
FROM future, (SELECT unnest(generate_series(0, 20)) AS scenario_id)""", "temp_c temp_delta")
def wx_scenario_delta(spark, sf_dir):
    """All 21 dashboard offsets, -5 to +5 in steps of one half, in one job."""
    deltas = [-5.0 + 0.5 * i for i in range(21)]
    out = H.add_scenarios(H.weather_for_horizon(future(spark, sf_dir)), deltas)
    return out.select("series_id", "step", "datetime", "scenario_id", "temp_delta", "temp_c")
