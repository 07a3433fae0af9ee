"""Forecast operators, products and the indicators drawn from them."""

from __future__ import annotations

from functools import reduce

from catalog import views as V
from catalog.registry import query, scratch
from catalog.weather import CLIM_HUM_SQL, CLIM_TEMP_SQL
from pyspark.sql import functions as F
from wattline.functions.uncertainty import HOURLY_UNCERTAINTY
from wattline.models.recursive import seasonal_naive_forecast
from wattline.models.ridge import fit_ridge
from wattline.models.boosting import binned_blocks, fit_forests
from wattline.models.registry import published_models, publish_models
from wattline.models.trees import CANDIDATES
from wattline.operators import features as X
from wattline.operators import horizon as H
from wattline.operators import kpi as K
from wattline.plans import forecasts as P
from wattline.plans import training
from wattline.sources.files import read_table, write_table


def outlook(spark, deltas=(0.0,)):
    return P.Outlook(V.holidays(spark), country="IN", temp_deltas=deltas, decimals=None)


def stored_history(spark, sf_dir, freq="hour"):
    """The cleaned grid as a table: every product reads its history more than once."""
    grid = {"hour": V.cleaned, "day": V.daily, "mixed": V.mixed}[freq](spark, sf_dir)
    return read_table(spark, write_table(grid, scratch(spark)))


# --- SQL of the naive products -----------------------------------------------------

_Z = {80: 1.282, 90: 1.645, 95: 1.960}


def intervals_sql(source: str, base: float, alpha: float) -> str:
    sigma = f"({base} * sqrt(1 + {alpha} * power(greatest(step, 1) / 24.0, 0.65)))"
    bounds = ", ".join(
        f"greatest(forecast_mw - {z} * {sigma}, 0) AS lower_bound_{k}, forecast_mw + {z} * {sigma} AS upper_bound_{k}"
        for k, z in _Z.items()
    )
    return f"SELECT *, {bounds}, {sigma} AS uncertainty_sigma_mw FROM {source}"


def hourly_product_sql(name: str, hours: int) -> str:
    return f"""{name}_future AS (
  SELECT series_id, step, CAST(hi + step * INTERVAL 1 HOUR AS TIMESTAMP) AS datetime
  FROM (SELECT series_id, max(datetime) AS hi FROM cleaned GROUP BY 1), (SELECT CAST(unnest(generate_series(1, {hours})) AS INTEGER) AS step)),
{name}_point AS (
  SELECT f.series_id, f.step, f.datetime, {CLIM_TEMP_SQL.replace("datetime", "f.datetime")} AS temp_c, {CLIM_HUM_SQL.replace("datetime", "f.datetime")} AS relative_humidity,
         'climatology' AS weather_source, 0 AS scenario_id, CAST(0.0 AS DOUBLE) AS temp_delta, greatest(h.demand_mw, 0) AS forecast_mw
  FROM {name}_future f LEFT JOIN cleaned h ON h.series_id = f.series_id AND h.datetime = f.datetime - INTERVAL 168 HOUR),
{name} AS ({intervals_sql(name + "_point", 130.0, 0.35)})"""


def next_day_sql() -> str:
    return V.with_(V.clean_sql(), hourly_product_sql("hours", 24)) + """, next_day AS (
  SELECT *, CAST(hour(datetime) AS INTEGER) AS hour, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week FROM hours) """


def next_week_sql() -> str:
    return (
        V.with_(V.clean_sql(), hourly_product_sql("week", 168), V.holidays_sql())
        + """, days AS (SELECT series_id, scenario_id, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS datetime,
    avg(forecast_mw) AS forecast_mean_mw, max(forecast_mw) AS peak_mw, min(forecast_mw) AS min_mw, sum(forecast_mw) / 1000 AS total_gwh,
    avg(temp_c) AS temp_c, avg(relative_humidity) AS relative_humidity, avg(lower_bound_90) AS lower_bound_mw, avg(upper_bound_90) AS upper_bound_mw
  FROM week GROUP BY 1, 2, 3),
week_days AS (SELECT *, dayname(datetime) AS day_of_week, CAST(isodow(datetime) >= 6 AS INTEGER) AS is_weekend,
    CAST(CAST(datetime AS DATE) IN (SELECT holiday_date FROM holidays) AS INTEGER) AS is_holiday,
    coalesce(forecast_mean_mw - lag(forecast_mean_mw) OVER (PARTITION BY series_id ORDER BY datetime), 0) AS day_over_day_change_mw
  FROM days) """
    )


def next_month_sql() -> str:
    return (
        V.with_(V.clean_sql(V.ORDERS_SQL, "day"), V.holidays_sql())
        + f""", ahead AS (
  SELECT series_id, step, CAST(hi + step * INTERVAL 1 DAY AS TIMESTAMP) AS datetime
  FROM (SELECT series_id, max(datetime) AS hi FROM cleaned GROUP BY 1), (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS step)),
hours AS (SELECT series_id, step, datetime AS day, CAST(datetime + h * INTERVAL 1 HOUR AS TIMESTAMP) AS datetime FROM ahead, (SELECT unnest(generate_series(0, 23)) AS h)),
weather AS (SELECT series_id, step, day AS datetime, avg({CLIM_TEMP_SQL}) AS temp_c, avg({CLIM_HUM_SQL}) AS relative_humidity FROM hours GROUP BY 1, 2, 3),
point AS (SELECT w.*, 'climatology' AS weather_source, 0 AS scenario_id, CAST(0.0 AS DOUBLE) AS temp_delta, greatest(c.demand_mw, 0) AS forecast_mw
  FROM weather w LEFT JOIN cleaned c ON c.series_id = w.series_id AND c.datetime = w.datetime - CAST(7 * ceil(w.step / 7.0) AS INTEGER) * INTERVAL 1 DAY),
bounded AS ({intervals_sql("point", 110.0, 0.4)}),
month AS (SELECT *, dayname(datetime) AS day_of_week, CAST(isodow(datetime) >= 6 AS INTEGER) AS is_weekend,
    CAST(CAST(datetime AS DATE) IN (SELECT holiday_date FROM holidays) AS INTEGER) AS is_holiday, forecast_mw * 24 / 1000 AS total_daily_gwh FROM bounded) """
    )


# --- operators ---------------------------------------------------------------------


@query("future_grid", V.with_(V.readings_sql(), V.grid_sql()) + """SELECT series_id, step, CAST(hi + step * INTERVAL 1 HOUR AS TIMESTAMP) AS datetime
FROM (SELECT series_id, max(datetime) AS hi FROM grid GROUP BY 1), (SELECT CAST(unnest(generate_series(1, 168)) AS INTEGER) AS step)""")
def future_grid(spark, sf_dir):
    return H.future_grid(V.hourly(spark, sf_dir), 168)


_DAILY = V.with_(V.clean_sql(V.ORDERS_SQL, "day"))


@query("history_tail", _DAILY + "SELECT series_id, datetime, demand_mw FROM cleaned QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY datetime DESC) <= 400", "demand_mw")
def history_tail(spark, sf_dir):
    return H.history_tail(V.daily(spark, sf_dir), 400, freq="day").select("series_id", "datetime", "demand_mw")


@query("append_future", _DAILY + """SELECT series_id, datetime, demand_mw, CAST(NULL AS INTEGER) AS step FROM cleaned
UNION ALL SELECT series_id, CAST(hi + step * INTERVAL 1 DAY AS TIMESTAMP), NULL, step
FROM (SELECT series_id, max(datetime) AS hi FROM cleaned GROUP BY 1), (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS step)""", "demand_mw")
def append_future(spark, sf_dir):
    history = V.daily(spark, sf_dir).select("series_id", "datetime", "demand_mw")
    return H.append_future(history, H.future_grid(history, 30, freq="day"))


@query("recursive_forecast_hourly", V.with_(V.clean_sql(), hourly_product_sql("week", 168)) + "SELECT series_id, step, datetime, forecast_mw FROM week", "forecast_mw")
def recursive_forecast_hourly(spark, sf_dir):
    """Naive recursion over a week."""
    history = stored_history(spark, sf_dir)
    return seasonal_naive_forecast(history, H.future_grid(history, 168), 168).select("series_id", "step", "datetime", "forecast_mw")


@query("recursive_forecast_daily", next_month_sql() + "SELECT series_id, step, datetime, forecast_mw FROM month", "forecast_mw")
def recursive_forecast_daily(spark, sf_dir):
    """Naive recursion over 30 days, four seasons and two days long."""
    history = stored_history(spark, sf_dir, "day")
    future = H.future_grid(history, 30, freq="day")
    return seasonal_naive_forecast(history, future, 7, freq="day").select("series_id", "step", "datetime", "forecast_mw")


@query("uncertainty_sigma", V.with_(V.clean_sql(), hourly_product_sql("week", 168)) + "SELECT series_id, step, uncertainty_sigma_mw FROM week", "uncertainty_sigma_mw")
def uncertainty_sigma(spark, sf_dir):
    future = H.future_grid(V.cleaned(spark, sf_dir), 168)
    return future.select("series_id", "step", HOURLY_UNCERTAINTY.sigma(F.col("step")).alias("uncertainty_sigma_mw"))


_BOUNDS = [f"{side}_bound_{k}" for k in _Z for side in ("lower", "upper")]


@query("prediction_intervals", V.with_(V.clean_sql(), hourly_product_sql("week", 168)) + f"SELECT series_id, step, forecast_mw, {', '.join(_BOUNDS)} FROM week", "forecast_mw " + " ".join(_BOUNDS))
def prediction_intervals(spark, sf_dir):
    history = stored_history(spark, sf_dir)
    point = seasonal_naive_forecast(history, H.future_grid(history, 168), 168)
    return HOURLY_UNCERTAINTY.attach_intervals(point, decimals=None).select("series_id", "step", "forecast_mw", *_BOUNDS)


# --- products ----------------------------------------------------------------------

_PRODUCT = ["series_id", "scenario_id", "step", "datetime", "forecast_mw", *_BOUNDS, "uncertainty_sigma_mw", "temp_c", "relative_humidity", "weather_source"]
_PRODUCT_DOUBLES = " ".join(["forecast_mw", *_BOUNDS, "uncertainty_sigma_mw", "temp_c", "relative_humidity"])


def next_day_unrounded(spark, sf_dir):
    return P.forecast_next_day(stored_history(spark, sf_dir), P.naive_forecaster("hour"), outlook(spark))


def next_week(spark, sf_dir):
    return P.forecast_next_week(stored_history(spark, sf_dir), P.naive_forecaster("hour"), outlook(spark))


def next_month(spark, sf_dir):
    return P.forecast_next_month(stored_history(spark, sf_dir, "day"), P.naive_forecaster("day"), outlook(spark), daily=True)


@query("forecast_next_day", next_day_sql() + f"SELECT {', '.join(_PRODUCT)}, hour, day_of_week FROM next_day", _PRODUCT_DOUBLES)
def forecast_next_day(spark, sf_dir):
    return next_day_unrounded(spark, sf_dir).select(*_PRODUCT, "hour", "day_of_week")


@query("forecast_next_week", next_week_sql() + f"SELECT {', '.join(_PRODUCT)} FROM week", _PRODUCT_DOUBLES)
def forecast_next_week(spark, sf_dir):
    return next_week(spark, sf_dir)[0].select(*_PRODUCT)


_DAY_COLUMNS = ["series_id", "scenario_id", "datetime", "forecast_mean_mw", "peak_mw", "min_mw", "total_gwh", "temp_c", "relative_humidity",
                "lower_bound_mw", "upper_bound_mw", "day_of_week", "is_weekend", "is_holiday", "day_over_day_change_mw"]
_DAY_DOUBLES = "forecast_mean_mw peak_mw min_mw total_gwh temp_c relative_humidity lower_bound_mw upper_bound_mw day_over_day_change_mw"


@query("week_daily_summary", next_week_sql() + f"SELECT {', '.join(_DAY_COLUMNS)} FROM week_days", _DAY_DOUBLES)
def week_daily_summary(spark, sf_dir):
    return next_week(spark, sf_dir)[1].select(*_DAY_COLUMNS)


_MONTH = [*_PRODUCT, "day_of_week", "is_weekend", "is_holiday", "total_daily_gwh"]


@query("forecast_next_month", next_month_sql() + f"SELECT {', '.join(_MONTH)} FROM month", _PRODUCT_DOUBLES + " total_daily_gwh")
def forecast_next_month(spark, sf_dir):
    return next_month(spark, sf_dir).select(*_MONTH)


def _ridge(spark, history, matrix, spec, alpha, freq, horizon, look):
    features = X.feature_columns(spec)
    fitted = fit_ridge(matrix, features, alpha)
    return P.ridge_forecaster(fitted, features, look, horizon=horizon, freq=freq, spec=spec)


def ridge_next_day(spark, sf_dir, deltas=(-5.0, 0.0, 5.0)):
    look = outlook(spark, deltas)
    history = stored_history(spark, sf_dir, "mixed")
    matrix = X.feature_matrix(history, look.holidays, freq="hour", spec=X.HOURLY, country="IN")
    return P.forecast_next_day(history, _ridge(spark, history, matrix, X.HOURLY, 10.0, "hour", 24, look), look)


def _inside():
    forecast = F.col("forecast_mw")
    inside = (F.col("lower_bound_90") <= forecast) & (forecast <= F.col("upper_bound_90")) & (forecast > 0)
    return inside.alias("inside")


def _steps_sql(source, unit, steps, scenarios=1, name="sound"):
    """Keys of the rows that a forecast of ``steps`` steps has."""
    return V.with_(V.clean_sql(source, unit)) + f"""SELECT series_id, CAST(scenario AS INTEGER) AS scenario_id, step, CAST(hi + step * INTERVAL 1 {unit} AS TIMESTAMP) AS datetime, true AS {name}
FROM (SELECT series_id, max(datetime) AS hi FROM cleaned GROUP BY 1), (SELECT CAST(unnest(generate_series(1, {steps})) AS INTEGER) AS step), (SELECT unnest(range({scenarios})) AS scenario)"""


@query("forecast_next_day_ridge", _steps_sql(V.MIXED_SQL, "hour", 24, 3, "inside"))
def forecast_next_day_ridge(spark, sf_dir):
    """Recursive ridge forecast of a long and a short series under three temperature scenarios: every row, above zero and inside its bounds."""
    return ridge_next_day(spark, sf_dir).select("series_id", "scenario_id", "step", "datetime", _inside())


@query("forecast_next_week_ridge", f"""SELECT series_id, scenario_id, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS datetime, true AS inside FROM ({_steps_sql(V.MIXED_SQL, "hour", 168)}) GROUP BY ALL""")
def forecast_next_week_ridge(spark, sf_dir):
    """Days of the recursive ridge forecast: their mean lies between the least and the largest hour."""
    look = outlook(spark)
    history = stored_history(spark, sf_dir, "mixed")
    matrix = X.feature_matrix(history, look.holidays, freq="hour", spec=X.HOURLY, country="IN")
    days = P.forecast_next_week(history, _ridge(spark, history, matrix, X.HOURLY, 10.0, "hour", 168, look), look)[1]
    mean = F.col("forecast_mean_mw")
    inside = (mean > 0) & (F.col("min_mw") <= mean + 1e-6) & (mean <= F.col("peak_mw") + 1e-6)
    return days.select("series_id", "scenario_id", "datetime", inside.alias("inside"))


@query("forecast_next_month_ridge", _steps_sql(V.ORDERS_SQL, "day", 30, name="inside"))
def forecast_next_month_ridge(spark, sf_dir):
    """Recursive daily ridge forecast with the full daily matrix, annual lag included."""
    look = outlook(spark)
    history = stored_history(spark, sf_dir, "day")
    matrix = X.feature_matrix(history, look.holidays, freq="day", country="IN")
    out = P.forecast_next_month(history, _ridge(spark, history, matrix, X.DAILY, 5.0, "day", 30, look), look, daily=True)
    return out.select("series_id", "scenario_id", "step", "datetime", _inside())


def _trees(spark, sf_dir, freq, candidate, horizon):
    """Recursive forecast of a tree candidate with its own rounds and the full matrix, a forest per series."""
    look = outlook(spark)
    spec = X.HOURLY if freq == "hour" else X.DAILY
    history = stored_history(spark, sf_dir, "mixed" if freq == "hour" else "day")
    matrix = X.feature_matrix(history, look.holidays, freq=freq, spec=spec, country="IN")
    matrix = read_table(spark, write_table(matrix, scratch(spark)))
    features = X.feature_columns(spec)
    forests = fit_forests(binned_blocks(matrix, features, freq=freq), {candidate: CANDIDATES[freq][candidate]})
    forests = read_table(spark, write_table(forests, scratch(spark)))
    forecaster = P.forest_forecaster(forests, features, look, horizon=horizon, freq=freq, spec=spec)
    out = forecaster(history, P.future_weather(history, horizon, look) if freq == "hour" else P.daily_future(history, look))
    # A sum of means of known values, give or take: far inside twice the largest value.
    known = history.groupBy("series_id").agg(F.max("demand_mw").alias("most"))
    sound = (F.col("forecast_mw") > 0) & (F.col("forecast_mw") < 2 * F.col("most"))
    return out.join(known, "series_id").select("series_id", "scenario_id", "step", "datetime", sound.alias("sound"))


@query("recursive_forecast_trees", _steps_sql(V.MIXED_SQL, "hour", 24))
def recursive_forecast_trees(spark, sf_dir):
    return _trees(spark, sf_dir, "hour", "Hourly Trees (Default)", 24)


@query("recursive_forecast_trees_week", _steps_sql(V.MIXED_SQL, "hour", 168))
def recursive_forecast_trees_week(spark, sf_dir):
    return _trees(spark, sf_dir, "hour", "Hourly Trees (Default)", 168)


@query("recursive_forecast_trees_month", _steps_sql(V.ORDERS_SQL, "day", 30))
def recursive_forecast_trees_month(spark, sf_dir):
    return _trees(spark, sf_dir, "day", "Daily Trees (Dedicated)", 30)


# Champions of the serving queries; the fourth series has none.
_SERVED = {"1-URGENT": training.NAIVE["day"], "2-HIGH": training.RIDGE["day"], "3-MEDIUM": "Daily Trees (Dedicated)", "5-LOW": training.NAIVE["day"]}
_TOO_SHORT = "too short for the folds"


def _published(spark, sf_dir):
    """History, published models of different kinds, and the champion table that they were made from."""
    history = stored_history(spark, sf_dir, "day")
    matrix = X.feature_matrix(history, V.holidays(spark), freq="day", country="IN")
    matrix = read_table(spark, write_table(matrix, scratch(spark)))
    model = F.create_map(*[F.lit(x) for pair in _SERVED.items() for x in pair])[F.col("series_id")]
    champions = history.select("series_id").distinct().withColumn("model", model)
    champions = champions.withColumn("reason", F.when(F.col("model").isNull(), F.lit(_TOO_SHORT)))
    features, path = X.feature_columns(X.DAILY), scratch(spark)
    naive = champions.withColumn("model", F.lit(training.NAIVE["day"]))
    publish_models(training.refit_each(matrix, naive, features, freq="day"), path, features=features, freq="day")
    publish_models(training.refit_each(matrix, champions, features, freq="day"), path, features=features, freq="day")
    return history, *published_models(spark, path), champions


_ROUTE = "CASE series_id " + " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in _SERVED.items()) + " END"


@query("forecast_champions", next_month_sql() + f"""SELECT series_id, step, datetime, {_ROUTE} AS model, true AS sound,
  CASE WHEN {_ROUTE} = '{training.NAIVE["day"]}' THEN forecast_mw END AS naive_mw FROM month WHERE {_ROUTE} IS NOT NULL""", "naive_mw")
def forecast_champions(spark, sf_dir):
    """The monthly product from published models: every series by its own champion."""
    history, models, row, _ = _published(spark, sf_dir)
    look = outlook(spark)
    forecaster = P.champion_forecaster(models, row["feature_columns"], look, horizon=30, freq="day")
    out = P.forecast_next_month(history, forecaster, look, daily=True)
    naive = F.when(F.col("model") == training.NAIVE["day"], F.col("forecast_mw"))
    return out.select("series_id", "step", "datetime", "model", (F.col("forecast_mw") > 0).alias("sound"), naive.alias("naive_mw"))


@query("unserved_champions", V.with_(V.ORDERS_SQL) + f"SELECT DISTINCT series_id, '{_TOO_SHORT}' AS reason, 2 AS version FROM readings WHERE {_ROUTE} IS NULL")
def unserved_champions(spark, sf_dir):
    """Series without a model, and why, in the newest of two published versions."""
    history, models, row, champions = _published(spark, sf_dir)
    return P.without_champion(history, models, champions).withColumn("version", F.lit(row["version"]).cast("int"))


_ALL_SQL = V.with_(V.readings_sql()) + """, ends AS (SELECT series_id, CAST(date_trunc('hour', max(datetime)) AS TIMESTAMP) AS hi FROM readings GROUP BY 1),
hours AS (SELECT series_id, hi + step * INTERVAL 1 HOUR AS datetime FROM ends, (SELECT unnest(generate_series(1, 168)) AS step))
SELECT 'next_day' AS product, count(*) * 24 AS n_rows FROM ends
UNION ALL SELECT 'next_week', count(*) FROM hours
UNION ALL SELECT 'next_week_daily', count(DISTINCT (series_id, CAST(datetime AS DATE))) FROM hours
UNION ALL SELECT 'next_month', count(*) * 30 FROM ends"""


@query("forecast_all", _ALL_SQL)
def forecast_all(spark, sf_dir):
    """All four naive products written as CSV; rows of each."""
    path = scratch(spark)
    history = stored_history(spark, sf_dir)
    P.forecast_all(history, lambda h: P.naive_forecaster("hour"), P.naive_forecaster("day"), outlook(spark), path)
    counts = [
        spark.read.option("header", True).csv(f"{path}/forecast_{name}").agg(F.lit(name).alias("product"), F.count(F.lit(1)).alias("n_rows"))
        for name in ("next_day", "next_week", "next_week_daily", "next_month")
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


# --- indicators --------------------------------------------------------------------

_FIRST = "arg_min({0}, ({1}, datetime))"


@query("kpi_day", next_day_sql() + f""", ramped AS (SELECT *, coalesce(forecast_mw - lag(forecast_mw) OVER (PARTITION BY series_id ORDER BY datetime), 0) AS ramp FROM next_day)
SELECT series_id, max(forecast_mw) AS peak_mw, {_FIRST.format('datetime', '-forecast_mw')} AS peak_time, min(forecast_mw) AS trough_mw, {_FIRST.format('datetime', 'forecast_mw')} AS trough_time,
  avg(forecast_mw) AS avg_mw, sum(forecast_mw) / 1000 AS total_gwh, avg(forecast_mw) / max(forecast_mw) AS load_factor, max(ramp) AS max_ramp_mw_hr
FROM ramped GROUP BY series_id""", "peak_mw trough_mw avg_mw total_gwh load_factor max_ramp_mw_hr")
def kpi_day(spark, sf_dir):
    return K.kpi_day(next_day_unrounded(spark, sf_dir))


@query("kpi_week", next_week_sql() + f"""SELECT series_id, max(peak_mw) AS week_peak_mw, {_FIRST.format('day_of_week', '-peak_mw')} AS peak_day,
  min(min_mw) AS week_min_mw, {_FIRST.format('day_of_week', 'min_mw')} AS min_day, sum(total_gwh) AS week_total_gwh FROM week_days GROUP BY series_id""", "week_peak_mw week_min_mw week_total_gwh")
def kpi_week(spark, sf_dir):
    return K.kpi_week(next_week(spark, sf_dir)[1])


@query("kpi_weekday_weekend", next_week_sql() + """SELECT *, (weekend_avg_mw - weekday_avg_mw) / weekday_avg_mw AS weekend_delta FROM (
  SELECT series_id, avg(forecast_mean_mw) FILTER (is_weekend = 0) AS weekday_avg_mw, avg(forecast_mean_mw) FILTER (is_weekend = 1) AS weekend_avg_mw FROM week_days GROUP BY series_id)""", "weekday_avg_mw weekend_avg_mw weekend_delta")
def kpi_weekday_weekend(spark, sf_dir):
    return K.kpi_weekday_weekend(next_week(spark, sf_dir)[1])


@query("kpi_max_dod", next_week_sql() + f"""SELECT series_id, {_FIRST.format('day_over_day_change_mw', '-abs(day_over_day_change_mw)')} AS max_change_mw,
  {_FIRST.format('day_of_week', '-abs(day_over_day_change_mw)')} AS max_change_day FROM week_days GROUP BY series_id""", "max_change_mw")
def kpi_max_dod(spark, sf_dir):
    return K.kpi_max_change(next_week(spark, sf_dir)[1])


@query("kpi_month", next_month_sql() + f"""SELECT series_id, sum(total_daily_gwh) AS month_total_gwh, sum(total_daily_gwh) / 1000 AS month_total_twh, max(forecast_mw) AS month_peak_mw,
  {_FIRST.format('datetime', '-forecast_mw')} AS month_peak_date, avg(forecast_mw) AS month_avg_mw, avg(temp_c) AS month_avg_temp FROM month GROUP BY series_id""", "month_total_gwh month_total_twh month_peak_mw month_avg_mw month_avg_temp")
def kpi_month(spark, sf_dir):
    return K.kpi_month(next_month(spark, sf_dir))


@query("weekly_energy", next_month_sql() + """, weeks AS (SELECT series_id, CAST(datetime + (7 - isodow(datetime)) * INTERVAL 1 DAY AS DATE) AS week_end, sum(total_daily_gwh) AS total_daily_gwh FROM month GROUP BY 1, 2)
SELECT *, 'Week ' || row_number() OVER (PARTITION BY series_id ORDER BY week_end) AS week FROM weeks""", "total_daily_gwh")
def weekly_energy(spark, sf_dir):
    return K.weekly_energy(next_month(spark, sf_dir))


_SPLIT = V.with_(V.readings_sql(), V.grid_sql()) + f""", future AS (
  SELECT series_id, step, CAST(hi + step * INTERVAL 1 HOUR AS TIMESTAMP) AS datetime
  FROM (SELECT series_id, max(datetime) AS hi FROM grid GROUP BY 1), (SELECT CAST(unnest(generate_series(1, 480)) AS INTEGER) AS step)),
sourced AS (SELECT f.series_id, f.step, f.datetime, CASE WHEN g.temp_c IS NOT NULL AND step <= 336 THEN 'nwp_forecast' ELSE 'climatology' END AS weather_source
  FROM future f LEFT JOIN grid g ON f.series_id = g.series_id AND f.datetime = g.datetime + INTERVAL 30 DAY) """


@query("weather_source_split", _SPLIT + "SELECT series_id, step, weather_source, CASE WHEN weather_source = 'nwp_forecast' THEN 'forecast' ELSE 'other' END AS part FROM sourced")
def weather_source_split(spark, sf_dir):
    from catalog.weather import future, weather_forecast

    rows = H.weather_for_horizon(future(spark, sf_dir), weather_forecast(spark, sf_dir), on=["series_id"])
    nwp, other = K.weather_source_split(rows)
    both = nwp.withColumn("part", F.lit("forecast")).unionByName(other.withColumn("part", F.lit("other")))
    return both.select("series_id", "step", "weather_source", "part")


@query("select_confidence_band", next_day_sql() + "SELECT series_id, datetime, forecast_mw, lower_bound_80 AS lower_bound, upper_bound_80 AS upper_bound FROM next_day", "forecast_mw lower_bound upper_bound")
def select_confidence_band(spark, sf_dir):
    return K.confidence_band(next_day_unrounded(spark, sf_dir), 80)


@query("preview_head", next_day_sql() + "SELECT series_id, datetime, forecast_mw, lower_bound_90, upper_bound_90, weather_source FROM next_day WHERE step <= 6", "forecast_mw lower_bound_90 upper_bound_90")
def preview_head(spark, sf_dir):
    return K.preview(next_day_unrounded(spark, sf_dir), 6, ["datetime", "forecast_mw", "lower_bound_90", "upper_bound_90", "weather_source"])


@query("planning_table", next_week_sql() + f"SELECT series_id, {', '.join(K.PLANNING_COLUMNS)} FROM week_days", "forecast_mean_mw peak_mw min_mw total_gwh temp_c day_over_day_change_mw")
def planning_table(spark, sf_dir):
    return K.planning_table(next_week(spark, sf_dir)[1])
