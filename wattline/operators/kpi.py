"""Operational indicators and summaries of forecast frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.calendar import day_name, is_weekend
from wattline.names import BY, HUMIDITY, TEMP, TIME, WEATHER_SOURCE
from wattline.operators.holidays import holiday_dates

FORECAST = "forecast_mw"
PLANNING_COLUMNS = (
    "datetime",
    "day_of_week",
    "forecast_mean_mw",
    "peak_mw",
    "min_mw",
    "total_gwh",
    "temp_c",
    "day_over_day_change_mw",
)


def _at_max(result: str | Column, value: Column, time: str) -> Column:
    """``result`` on the row with the largest value; the earliest row wins ties."""
    # Smallest (-value, time) instead of largest (value, -time): times have no negative.
    return F.min_by(result, F.when(value.isNotNull(), F.struct((-value).alias("v"), F.col(time).alias("t"))))


def _at_min(result: str | Column, value: Column, time: str) -> Column:
    return F.min_by(result, F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(time).alias("t"))))


def add_difference(
    df: DataFrame, value: str, name: str, *, by: Sequence[str] = BY, time: str = TIME, decimals: int | None = None
) -> DataFrame:
    """Change from the previous row, 0 on the first one. For frames of bounded length,
    such as a forecast; on long grids use ``ramp``."""
    change = F.coalesce(F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(time)), F.lit(0.0))
    return df.withColumn(name, change if decimals is None else F.round(change, decimals))


def week_daily_summary(
    hourly: DataFrame,
    holidays: DataFrame | None = None,
    *,
    country: str | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
    decimals: int | None = 1,
) -> DataFrame:
    """One row per day of an hourly forecast."""
    day = F.to_date(F.col(time)).cast("timestamp_ntz")
    daily = hourly.groupBy(*by, day.alias("_day")).agg(
        F.avg(FORECAST).alias("forecast_mean_mw"),
        F.max(FORECAST).alias("peak_mw"),
        F.min(FORECAST).alias("min_mw"),
        (F.sum(FORECAST) / 1000.0).alias("total_gwh"),
        F.avg(TEMP).alias(TEMP),
        F.avg(HUMIDITY).alias(HUMIDITY),
        F.avg("lower_bound_90").alias("lower_bound_mw"),
        F.avg("upper_bound_90").alias("upper_bound_mw"),
    )
    daily = daily.withColumnRenamed("_day", time)
    daily = daily.withColumns({"day_of_week": day_name(F.col(time)), "is_weekend": is_weekend(F.col(time))})
    daily = add_holiday_flag(daily, holidays, country=country, time=time)
    return add_difference(
        daily, "forecast_mean_mw", "day_over_day_change_mw", by=by, time=time, decimals=decimals
    )


def add_holiday_flag(
    df: DataFrame, holidays: DataFrame | None, *, country: str | None = None, time: str = TIME
) -> DataFrame:
    if holidays is None:
        return df.withColumn("is_holiday", F.lit(0))
    dates = holiday_dates(holidays, country).select(F.col("date").alias("_date"), "is_holiday")
    joined = df.join(dates, F.to_date(F.col(time)) == F.col("_date"), "left").drop("_date")
    return joined.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))


def kpi_day(hourly: DataFrame, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Peak, trough, mean, energy, load factor and steepest ramp of an hourly forecast."""
    v = F.col(FORECAST)
    ramped = add_difference(hourly, FORECAST, "ramp_mw_hr", by=by, time=time)
    return ramped.groupBy(*by).agg(
        F.max(v).alias("peak_mw"),
        _at_max(time, v, time).alias("peak_time"),
        F.min(v).alias("trough_mw"),
        _at_min(time, v, time).alias("trough_time"),
        F.avg(v).alias("avg_mw"),
        (F.sum(v) / 1000.0).alias("total_gwh"),
        (F.avg(v) / F.max(v)).alias("load_factor"),
        F.max("ramp_mw_hr").alias("max_ramp_mw_hr"),
    )


def kpi_week(daily: DataFrame, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    peak, low = F.col("peak_mw"), F.col("min_mw")
    return daily.groupBy(*by).agg(
        F.max(peak).alias("week_peak_mw"),
        _at_max("day_of_week", peak, time).alias("peak_day"),
        F.min(low).alias("week_min_mw"),
        _at_min("day_of_week", low, time).alias("min_day"),
        F.sum("total_gwh").alias("week_total_gwh"),
    )


def kpi_weekday_weekend(daily: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    weekend = F.col("is_weekend") == 1
    averages = daily.groupBy(*by).agg(
        F.avg(F.when(~weekend, F.col("forecast_mean_mw"))).alias("weekday_avg_mw"),
        F.avg(F.when(weekend, F.col("forecast_mean_mw"))).alias("weekend_avg_mw"),
    )
    change = (F.col("weekend_avg_mw") - F.col("weekday_avg_mw")) / F.col("weekday_avg_mw")
    return averages.withColumn("weekend_delta", change)


def kpi_max_change(daily: DataFrame, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Day with the largest change from the day before, in either direction."""
    size = F.abs(F.col("day_over_day_change_mw"))
    return daily.groupBy(*by).agg(
        _at_max("day_over_day_change_mw", size, time).alias("max_change_mw"),
        _at_max("day_of_week", size, time).alias("max_change_day"),
    )


def kpi_month(daily: DataFrame, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    v = F.col(FORECAST)
    return daily.groupBy(*by).agg(
        F.sum("total_daily_gwh").alias("month_total_gwh"),
        (F.sum("total_daily_gwh") / 1000.0).alias("month_total_twh"),
        F.max(v).alias("month_peak_mw"),
        _at_max(time, v, time).alias("month_peak_date"),
        F.avg(v).alias("month_avg_mw"),
        F.avg(TEMP).alias("month_avg_temp"),
    )


def weekly_energy(daily: DataFrame, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Energy per week ending on Sunday, numbered per series."""
    week_end = F.next_day(F.date_sub(F.to_date(F.col(time)), 1), "SU")
    weeks = daily.groupBy(*by, week_end.alias("week_end")).agg(F.sum("total_daily_gwh").alias("total_daily_gwh"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("week_end"))
    return weeks.withColumn("week", F.concat(F.lit("Week "), number.cast("string")))


def weather_source_split(daily: DataFrame, source: str = "nwp_forecast") -> tuple[DataFrame, DataFrame]:
    """Rows with weather from ``source``, and all others."""
    is_source = F.col(WEATHER_SOURCE).eqNullSafe(source)
    return daily.filter(is_source), daily.filter(~is_source)


def confidence_band(df: DataFrame, level: int = 90, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Forecast with the bounds of one confidence level."""
    if level not in (80, 90, 95):
        raise ValueError(f"level must be 80, 90 or 95, got {level}")
    return df.select(
        *by,
        time,
        FORECAST,
        F.col(f"lower_bound_{level}").alias("lower_bound"),
        F.col(f"upper_bound_{level}").alias("upper_bound"),
    )


def preview(df: DataFrame, n: int, columns: Sequence[str], *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """First ``n`` rows of each series with the selected columns."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(time))
    return df.withColumn("_row", first).filter(F.col("_row") <= n).select(*by, *[c for c in columns if c not in by])


def planning_table(daily: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    return daily.select(*by, *PLANNING_COLUMNS)
