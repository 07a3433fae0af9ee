"""Future grids, weather for the horizon, temperature scenarios, bounded history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.grid import step_of, time_of
from wattline.functions.weather import Climatology
from wattline.names import BY, HUMIDITY, SCENARIO, STEP, TEMP, TIME, WEATHER_SOURCE
from wattline.operators.chunks import attach

# Days for which a weather forecast is used, and the most a forecast covers.
FORECAST_DAYS_USED = 14
FORECAST_DAYS_MAX = 16


def check_days(days: int) -> int:
    if days > FORECAST_DAYS_MAX:
        raise ValueError(f"a weather forecast covers at most {FORECAST_DAYS_MAX} days, not {days}")
    return days


def future_grid(
    history: DataFrame, horizon: int, *, freq: str = "hour", by: Sequence[str] = BY, time: str = TIME
) -> DataFrame:
    """The ``horizon`` steps after the last one of each series, numbered from 1."""
    last = F.max(step_of(F.col(time), freq))
    return (
        history.groupBy(*by)
        .agg(last.alias("_last"))
        .withColumn(STEP, F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(*by, time_of(F.col("_last") + F.col(STEP), freq).alias(time), STEP)
    )


def history_tail(
    history: DataFrame, steps: int, *, freq: str = "hour", by: Sequence[str] = BY, time: str = TIME, **grid
) -> DataFrame:
    """The last ``steps`` grid steps of each series."""
    step = step_of(F.col(time), freq)
    last = F.max(step).alias("_newest")
    # The series that ends first bounds what the scan reads.
    ends = history.groupBy(*by).agg(last)
    earliest = ends.agg(time_of(F.min("_newest") - steps + 1, freq)).scalar()
    dated = attach(history.filter(F.col(time) >= earliest), [last], by=by, freq=freq, time=time, **grid)
    return dated.filter(step_of(F.col(time), freq) > F.col("_newest") - steps).drop("_newest")


def append_future(history: DataFrame, future: DataFrame) -> DataFrame:
    """History and future rows together; what only one side has is null on the other."""
    return history.unionByName(future, allowMissingColumns=True)


def limit_weather_forecast(
    forecast: DataFrame, start: Column, days: int = FORECAST_DAYS_USED, time: str = TIME
) -> DataFrame:
    """Forecast rows of at most ``days`` days from ``start``."""
    end = start.cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(check_days(days)))
    return forecast.filter(F.col(time) < end)


def weather_for_horizon(
    future: DataFrame,
    forecast: DataFrame | None = None,
    climatology: Climatology = Climatology(),
    *,
    days: int = FORECAST_DAYS_USED,
    on: Sequence[str] = (),
    time: str = TIME,
) -> DataFrame:
    """Add weather and its source to future rows.

    A forecast row counts if it has a temperature and lies in the first ``days`` days of
    the horizon; every other step gets the climatology. ``forecast`` has one row per time
    (and per value of ``on``, such as the series) and may carry its own source label.
    """
    t = F.col(time)
    clim = {TEMP: climatology.temp(t), HUMIDITY: climatology.humidity(t)}
    if forecast is None:
        return future.withColumns(clim | {WEATHER_SOURCE: F.lit("climatology")})
    label = F.col(WEATHER_SOURCE) if WEATHER_SOURCE in forecast.columns else F.lit("nwp_forecast")
    known = forecast.filter(F.col(TEMP).isNotNull()).select(
        *on,
        time,
        F.col(TEMP).alias("_temp"),
        F.col(HUMIDITY).alias("_humidity"),
        label.alias("_source"),
    )
    joined = future.join(known, [*on, time], "left")
    used = F.col("_temp").isNotNull() & (F.col(STEP) <= check_days(days) * 24)
    return joined.select(
        *future.columns,
        F.when(used, F.col("_temp")).otherwise(clim[TEMP]).alias(TEMP),
        F.when(used, F.col("_humidity")).otherwise(clim[HUMIDITY]).alias(HUMIDITY),
        F.when(used, F.col("_source")).otherwise("climatology").alias(WEATHER_SOURCE),
    )


def add_scenarios(future: DataFrame, deltas: Sequence[float] = (0.0,)) -> DataFrame:
    """Repeat future rows once per temperature offset, numbered from 0."""
    options = F.array(
        *[F.struct(F.lit(i).alias(SCENARIO), F.lit(float(d)).alias("temp_delta")) for i, d in enumerate(deltas)]
    )
    return (
        future.withColumn("_scenario", F.explode(options))
        .select(*future.columns, "_scenario.*")
        .withColumn(TEMP, F.col(TEMP) + F.col("temp_delta"))
    )
