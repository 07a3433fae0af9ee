"""The three forecast products."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.calendar import day_name, is_weekend
from wattline.functions.uncertainty import DAILY_UNCERTAINTY, HOURLY_UNCERTAINTY, Uncertainty
from wattline.functions.weather import Climatology
from wattline.models.recursive import (
    FORECAST,
    recursive_forest_forecast,
    recursive_model_forecast,
    recursive_ridge_forecast,
    seasonal_naive_forecast,
)
from wattline.models.ridge import ALL_ROWS
from wattline.names import BY, HORIZONS, HUMIDITY, SCENARIO, STEP, TEMP, TIME, WEATHER_SOURCE
from wattline.operators.features import SPECS, FeatureSpec
from wattline.operators.horizon import add_scenarios, future_grid, weather_for_horizon
from wattline.operators.kpi import add_holiday_flag, week_daily_summary
from wattline.operators.resample import first_label, resample_daily_mean
from wattline.sources.files import write_csv

# Days of the monthly product, seasons of the naive model, and the
# constant forecast of the monthly product when there is no model.
MONTH_DAYS = 30
SEASON = {"hour": 168, "day": 7}
NO_MODEL_MW = 5000.0

# (history, future) -> future with a forecast column
Forecaster = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Outlook:
    """What is known about the horizon besides the history."""

    holidays: DataFrame
    country: str | None = None
    weather: DataFrame | None = None
    climatology: Climatology = Climatology()
    temp_deltas: Sequence[float] = (0.0,)
    decimals: int | None = 2


def naive_forecaster(freq: str, by: Sequence[str] = BY) -> Forecaster:
    return lambda history, future: seasonal_naive_forecast(history, future, SEASON[freq], freq=freq, by=by)


def ridge_forecaster(
    fitted: DataFrame,
    features: Sequence[str],
    outlook: Outlook,
    *,
    horizon: int,
    freq: str = "hour",
    spec: FeatureSpec | None = None,
    by: Sequence[str] = BY,
) -> Forecaster:
    return lambda history, future: recursive_ridge_forecast(
        history,
        future,
        fitted,
        features,
        outlook.holidays,
        spec=spec or SPECS[freq],
        horizon=horizon,
        country=outlook.country,
        by=by,
    )


def forest_forecaster(
    forests: DataFrame,
    features: Sequence[str],
    outlook: Outlook,
    *,
    horizon: int,
    freq: str = "hour",
    spec: FeatureSpec | None = None,
    by: Sequence[str] = BY,
) -> Forecaster:
    return lambda history, future: recursive_forest_forecast(
        history,
        future,
        forests,
        features,
        outlook.holidays,
        spec=spec or SPECS[freq],
        horizon=horizon,
        country=outlook.country,
        by=by,
    )


def champion_forecaster(
    models: DataFrame,
    features: Sequence[str],
    outlook: Outlook,
    *,
    horizon: int,
    freq: str = "hour",
    spec: FeatureSpec | None = None,
    by: Sequence[str] = BY,
) -> Forecaster:
    """Each series by its own published model (``published_models``): naive, ridge or forest.

    Adds the ``model`` of the series. Series without one have no rows; ``without_champion`` lists them.
    """
    kinds = {r["kind"] for r in models.select("kind").distinct().collect()}
    options = dict(horizon=horizon, freq=freq, spec=spec, by=by)

    def forecaster(kind: str, own: DataFrame) -> Forecaster:
        if kind == "naive":
            return naive_forecaster(freq, by)
        if kind == "ridge":
            return ridge_forecaster(own.withColumn("fold", F.lit(ALL_ROWS)), features, outlook, **options)
        return forest_forecaster(own.select(*by, "forest.*"), features, outlook, **options)

    def forecast(history: DataFrame, future: DataFrame) -> DataFrame:
        out = None
        for kind in sorted(kinds):
            own = models.filter(F.col("kind") == kind)
            names = own.select(*by, "model")
            mine = [df.join(names, list(by), "left_semi") for df in (history, future)]
            part = forecaster(kind, own)(*mine).join(names, list(by))
            out = part if out is None else out.unionByName(part)
        if out is None:
            none = {FORECAST: F.lit(None).cast("double"), "model": F.lit(None).cast("string")}
            return future.limit(0).withColumns(none)
        return out.select(*future.columns, FORECAST, "model")

    return forecast


def without_champion(history: DataFrame, models: DataFrame, champions: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Series of ``history`` that no model serves and the ``reason``, as ``champions`` gives it."""
    series = history.select(*by).distinct().join(models.select(*by), list(by), "left_anti")
    unknown = F.lit("not in the training table")
    if champions is None:
        return series.withColumn("reason", unknown)
    return series.join(champions.select(*by, "reason"), list(by), "left").withColumn("reason", F.coalesce("reason", unknown))


def model_forecaster(
    model: PipelineModel,
    outlook: Outlook,
    *,
    horizon: int,
    freq: str = "hour",
    spec: FeatureSpec | None = None,
    by: Sequence[str] = BY,
) -> Forecaster:
    """For any Spark ML model over all series: one job per step."""
    return lambda history, future: recursive_model_forecast(
        history,
        future,
        model,
        outlook.holidays,
        spec=spec or SPECS[freq],
        horizon=horizon,
        country=outlook.country,
        by=by,
    )


def constant_forecaster(value: float = NO_MODEL_MW) -> Forecaster:
    return lambda history, future: future.withColumn(FORECAST, F.lit(float(value)))


def future_weather(history: DataFrame, horizon: int, outlook: Outlook, by: Sequence[str] = BY) -> DataFrame:
    """Hourly future rows with weather, once per temperature scenario."""
    future = future_grid(history, horizon, freq="hour", by=by)
    on = [c for c in by if outlook.weather is not None and c in outlook.weather.columns]
    weather = weather_for_horizon(future, outlook.weather, outlook.climatology, on=on)
    return add_scenarios(weather, outlook.temp_deltas)


def _hourly_product(
    history: DataFrame, forecaster: Forecaster, outlook: Outlook, horizon: int, spread: Uncertainty, by: Sequence[str]
) -> DataFrame:
    predicted = forecaster(history, future_weather(history, horizon, outlook, by))
    return spread.attach_intervals(predicted, decimals=outlook.decimals)


def forecast_next_day(
    history: DataFrame,
    forecaster: Forecaster,
    outlook: Outlook,
    *,
    spread: Uncertainty = HOURLY_UNCERTAINTY,
    by: Sequence[str] = BY,
) -> DataFrame:
    """24 hourly rows per series and scenario."""
    out = _hourly_product(history, forecaster, outlook, HORIZONS["next_day"], spread, by)
    return out.withColumns({"hour": F.hour(TIME), "day_of_week": F.weekday(TIME)})


def forecast_next_week(
    history: DataFrame,
    forecaster: Forecaster,
    outlook: Outlook,
    *,
    spread: Uncertainty = HOURLY_UNCERTAINTY,
    by: Sequence[str] = BY,
) -> tuple[DataFrame, DataFrame]:
    """168 hourly rows per series and scenario, and their summary per day."""
    hourly = _hourly_product(history, forecaster, outlook, HORIZONS["next_week"], spread, by)
    daily = week_daily_summary(
        hourly,
        outlook.holidays,
        country=outlook.country,
        by=[*by, SCENARIO],
        decimals=None if outlook.decimals is None else 1,
    )
    return hourly, daily


def daily_future(history: DataFrame, outlook: Outlook, by: Sequence[str] = BY) -> DataFrame:
    """30 daily rows after the last day of history, with daily weather per scenario.

    Weather is made hourly from midnight of the first day and averaged per day; the
    source of a day is that of its first hour.
    """
    days = future_grid(history, MONTH_DAYS, freq="day", by=by)
    hours = days.withColumn("_hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        *by,
        (F.col(TIME) + F.make_dt_interval(hours=F.col("_hour"))).alias(TIME),
        ((F.col(STEP) - 1) * 24 + F.col("_hour") + 1).alias(STEP),
    )
    on = [c for c in by if outlook.weather is not None and c in outlook.weather.columns]
    hourly = add_scenarios(
        weather_for_horizon(hours, outlook.weather, outlook.climatology, on=on), outlook.temp_deltas
    )
    return hourly.groupBy(
        *by,
        SCENARIO,
        "temp_delta",
        F.to_date(TIME).cast("timestamp_ntz").alias("_day"),
        F.ceil(F.col(STEP) / 24).cast("int").alias("_step"),
    ).agg(
        F.avg(TEMP).alias(TEMP),
        F.avg(HUMIDITY).alias(HUMIDITY),
        first_label(WEATHER_SOURCE),
    ).withColumnsRenamed({"_day": TIME, "_step": STEP})


def forecast_next_month(
    history: DataFrame,
    forecaster: Forecaster | None,
    outlook: Outlook,
    *,
    spread: Uncertainty = DAILY_UNCERTAINTY,
    by: Sequence[str] = BY,
    daily: bool = False,
) -> DataFrame:
    """30 daily rows per series and scenario. ``daily`` says that ``history`` is daily already."""
    past = history if daily else resample_daily_mean(history, by=by)
    predicted = (forecaster or constant_forecaster())(past, daily_future(past, outlook, by))
    out = spread.attach_intervals(predicted, decimals=outlook.decimals)
    energy = F.col(FORECAST) * 24.0 / 1000.0
    out = out.withColumns(
        {
            "day_of_week": day_name(F.col(TIME)),
            "is_weekend": is_weekend(F.col(TIME)),
            "total_daily_gwh": energy if outlook.decimals is None else F.round(energy, 2),
        }
    )
    return add_holiday_flag(out, outlook.holidays, country=outlook.country)


def forecast_all(
    history: DataFrame,
    hourly: Callable[[int], Forecaster],
    daily: Forecaster | None,
    outlook: Outlook,
    path: str | None = None,
    *,
    by: Sequence[str] = BY,
) -> dict[str, DataFrame]:
    """All products; with ``path`` also written there as CSV.

    ``hourly`` gives the forecaster for a number of steps. ``history`` is read several
    times, so it should be a stored table.
    """
    week_hourly, week_daily = forecast_next_week(history, hourly(HORIZONS["next_week"]), outlook, by=by)
    products = {
        "next_day": forecast_next_day(history, hourly(HORIZONS["next_day"]), outlook, by=by),
        "next_week": week_hourly,
        "next_week_daily": week_daily,
        "next_month": forecast_next_month(history, daily, outlook, by=by),
    }
    if path is not None:
        for name, df in products.items():
            write_csv(df, f"{path}/forecast_{name}")
    return products


__all__ = [
    "Outlook",
    "champion_forecaster",
    "constant_forecaster",
    "daily_future",
    "forecast_all",
    "forecast_next_day",
    "forecast_next_month",
    "forecast_next_week",
    "forest_forecaster",
    "future_weather",
    "model_forecaster",
    "naive_forecaster",
    "ridge_forecaster",
    "without_champion",
]
