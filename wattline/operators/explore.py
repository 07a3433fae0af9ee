"""Profiles, summary statistics, autocorrelation and decomposition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.grid import step_of
from wattline.names import BY, DEMAND, HUMIDITY, TEMP, TIME
from wattline.operators.chunks import attach, windowed
from wattline.operators.metrics import tail

# Autocorrelation lags, steps per season, and rows from the end at which
# the zoomed week starts.
ACF_LAGS = 48
PERIOD = 24
ZOOM_ROWS = 24 * 60


def ramp(
    df: DataFrame, value: str = DEMAND, *, name: str = "ramp_mw_hr", freq: str = "hour", by: Sequence[str] = BY, **grid
) -> DataFrame:
    """Change from the previous step of a dense grid, 0 on the first one."""

    def stage(rows: DataFrame, w) -> DataFrame:
        return rows.withColumn(name, F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))

    return windowed(df, 1, stage, freq=freq, by=by, **grid)


def _profile(df: DataFrame, part, name: str, value: str, by: Sequence[str], time: str) -> DataFrame:
    return df.groupBy(*by, part(F.col(time)).alias(name)).agg(F.avg(value).alias("mean_mw"))


def profile_hour(df: DataFrame, value: str = DEMAND, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    return _profile(df, F.hour, "hour", value, by, time)


def profile_day_of_week(df: DataFrame, value: str = DEMAND, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    return _profile(df, F.weekday, "day_of_week", value, by, time)


def profile_month(df: DataFrame, value: str = DEMAND, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    return _profile(df, F.month, "month", value, by, time)


def week_zoom(
    df: DataFrame, *, rows_back: int = ZOOM_ROWS, days: int = 7, by: Sequence[str] = BY, freq: str = "hour",
    time: str = TIME, **grid,
) -> DataFrame:
    """Seven days, both ends included, from ``rows_back`` steps before the end of a dense grid."""
    newest = F.max(step_of(F.col(time), freq)).alias("_newest")
    dated = attach(df, [newest], by=by, freq=freq, time=time, **grid)
    start = F.col("_newest") - (rows_back - 1)
    steps = days * 24 if freq == "hour" else days
    return dated.filter(step_of(F.col(time), freq).between(start, start + steps)).drop("_newest")


def recent_window(df: DataFrame, rows: int, **kwargs) -> DataFrame:
    """The last ``rows`` rows of each series."""
    return tail(df, rows, **kwargs)


def summary_stats(df: DataFrame, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(DEMAND).alias("demand_mean"),
        F.stddev_samp(DEMAND).alias("demand_std"),
        F.min(TEMP).alias("temp_min"),
        F.max(TEMP).alias("temp_max"),
    )


def weather_demand_pairs(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    return df.select(*by, TEMP, HUMIDITY, DEMAND)


def weather_demand_correlation(df: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    return df.groupBy(*by).agg(
        F.corr(TEMP, DEMAND).alias("temp_corr"), F.corr(HUMIDITY, DEMAND).alias("humidity_corr")
    )


def acf(
    df: DataFrame, lags: int = ACF_LAGS, value: str = DEMAND, *, freq: str = "hour", by: Sequence[str] = BY,
    time: str = TIME, **grid,
) -> DataFrame:
    """Autocorrelation of a dense grid without gaps, one row per series and lag."""
    centred = attach(df.select(*by, time, value), [F.avg(value).alias("_mean")], by=by, freq=freq, time=time, **grid)
    centred = centred.select(*by, time, (F.col(value) - F.col("_mean")).alias("_x"))

    def stage(rows: DataFrame, w) -> DataFrame:
        return rows.withColumns({f"_x{k}": F.lag("_x", k).over(w) for k in range(1, lags + 1)})

    shifted = windowed(centred, lags, stage, freq=freq, by=by, time=time, **grid)
    total = F.sum(F.col("_x") * F.col("_x"))
    # A missing product at the head of a series counts nothing; a series shorter than the lag has 0.
    products = [
        F.coalesce(F.sum(F.col("_x") * F.col(f"_x{k}")), F.lit(0.0)) / total for k in range(1, lags + 1)
    ]
    return (
        shifted.groupBy(*by)
        .agg(F.array(F.lit(1.0), *products).alias("_acf"))
        .select(*by, F.posexplode("_acf").alias("lag", "acf"))
    )


def _partial(correlations: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion on autocorrelations of lags 0, 1, ..."""
    out = np.ones(len(correlations))
    phi = np.empty(0)
    for k in range(1, len(correlations)):
        back = correlations[k - 1 : 0 : -1]
        ahead = correlations[1:k]
        last = (correlations[k] - phi @ back) / (1.0 - phi @ ahead)
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def pacf(correlations: DataFrame, *, by: Sequence[str] = BY) -> DataFrame:
    """Partial autocorrelations from the result of ``acf`` (49 numbers per series)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _partial(np.asarray(v, float)))

    packed = correlations.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("_acf")
    )
    return packed.withColumn("_pacf", solve("_acf")).select(*by, F.posexplode("_pacf").alias("lag", "pacf"))


def seasonal_decompose(
    df: DataFrame, period: int = PERIOD, value: str = DEMAND, *, freq: str = "hour", by: Sequence[str] = BY,
    time: str = TIME, **grid,
) -> DataFrame:
    """Classical additive decomposition of a dense grid without gaps.

    The trend is a centred moving average over one period with half weights at both ends,
    the seasonal part the mean deviation per phase, shifted to sum to zero. The trend
    and remainder are null for half a period at either end.
    """
    half = period // 2

    def trend_stage(rows: DataFrame, w) -> DataFrame:
        inner = F.sum(value).over(w.rowsBetween(-half + 1, half - 1))
        ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        known = F.count(value).over(w.rowsBetween(-half, half)) == 2 * half + 1
        return rows.withColumn("trend", F.when(known, (inner + ends) / period))

    base = df.select(*by, time, value)
    trended = windowed(base, half, trend_stage, ahead=half, freq=freq, by=by, time=time, **grid)
    phase = F.pmod(step_of(F.col(time), freq), F.lit(period))
    detrended = F.col(value) - F.col("trend")
    means = F.array(*[F.avg(F.when(phase == p, detrended)) for p in range(period)]).alias("_phases")
    known = F.filter("_phases", lambda x: x.isNotNull())
    centre = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    joined = attach(
        trended, [means], ["_phases", centre.alias("_centre")], by=by, freq=freq, time=time, **grid
    )
    seasonal = F.get(F.col("_phases"), phase.cast("int")) - F.col("_centre")
    return joined.select(
        *by,
        time,
        value,
        "trend",
        seasonal.alias("seasonal"),
        (F.col(value) - F.col("trend") - seasonal).alias("resid"),
    )
