"""Forecast accuracy metrics and error diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.names import BY, DEMAND, TIME
from wattline.operators.chunks import attach, row_positions

METRICS = ("mape", "mae", "rmse", "r2", "wape", "max_err")

# Cumulative lead-time segments, as (label, number of leading rows).
SEGMENTS = (("Next-Day (1-24h)", 24), ("Next-Week (1-168h)", 168), ("Next-Month (1-720h)", 720))

# Rows in the 60-day holdout, bins of the residual histogram.
HOLDOUT_ROWS = 60 * 24
HISTOGRAM_BINS = 40


def _known(*columns: Column) -> Column:
    """Neither null nor NaN, in any of the columns."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c.cast("double"))
    return out


def usable_pairs(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Rows that count for the metrics: both values known, neither NaN, and the actual not zero."""
    return df.filter(_known(F.col(actual), F.col(predicted)) & (F.col(actual) != 0))


def metric_columns(actual: str = "y_true", predicted: str = "y_pred") -> dict[str, Column]:
    """Aggregates over usable pairs; all null when there is none."""
    y, p = F.col(actual), F.col(predicted)
    used = _known(y, p) & (y != 0)
    error = F.when(used, y - p)
    truth = F.when(used, y)
    squared = F.sum(error * error)
    spread = F.var_pop(truth) * F.count(truth)
    return {
        "mape": F.avg(F.abs(error) / F.abs(y)),
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(F.count(truth) < 2, F.lit(None).cast("double"))
        .when(spread == 0, F.when(squared == 0, 1.0).otherwise(0.0))
        .otherwise(1 - squared / spread),
        "wape": F.sum(F.abs(error)) / F.sum(F.abs(truth)),
        "max_err": F.max(F.abs(error)),
    }


def metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    actual: str = "y_true",
    predicted: str = "y_pred",
    only: Sequence[str] = METRICS,
) -> DataFrame:
    """All metrics per group in one aggregation."""
    columns = metric_columns(actual, predicted)
    return df.groupBy(*by).agg(*[columns[m].alias(m) for m in only])


def horizon_segments(
    df: DataFrame,
    *,
    by: Sequence[str] = BY,
    time: str = TIME,
    actual: str = "y_true",
    predicted: str = "y_pred",
    segments: Sequence[tuple[str, int]] = SEGMENTS,
) -> DataFrame:
    """Metrics over the first 24, 168 and 720 known rows of each series.

    The row-number filter lets Spark keep only the leading rows of a series in every
    task before it shuffles them.
    """
    longest = max(n for _, n in segments)
    leading = (
        df.filter(_known(F.col(actual), F.col(predicted)))
        .select(*by, time, actual, predicted)
        .withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(time)))
        .filter(F.col("_row") <= longest)
    )
    labels = [F.when(F.col("_row") <= n, F.lit(label)) for label, n in segments]
    tagged = leading.withColumn("segment", F.explode(F.array_compact(F.array(*labels))))
    columns = metric_columns(actual, predicted)
    return tagged.groupBy(*by, "segment").agg(
        *[c.alias(m) for m, c in columns.items()], F.count(F.lit(1)).alias("n_observations")
    )


def tail(df: DataFrame, n: int, *, by: Sequence[str] = BY, freq: str = "hour", time: str = TIME, **grid) -> DataFrame:
    """The last ``n`` rows of each series."""
    numbered = row_positions(df, by=by, freq=freq, time=time, position="_pos", total="_total", last=n, **grid)
    return numbered.filter(F.col("_total") - F.col("_pos") <= n).drop("_pos", "_total")


def residuals(df: DataFrame, actual: str = DEMAND, predicted: str = "pred") -> DataFrame:
    """Add ``residual`` and ``abs_pct_error`` (in percent); null where either value is missing or NaN."""
    residual = F.when(_known(F.col(actual), F.col(predicted)), F.col(predicted) - F.col(actual))
    # A zero actual has no percentage error.
    return df.withColumns(
        {"residual": residual, "abs_pct_error": F.try_divide(F.abs(residual), F.col(actual)) * 100.0}
    )


def residual_summary(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("residual").alias("n_residuals"),
        F.avg("residual").alias("residual_mean"),
        F.stddev_samp("residual").alias("residual_std"),
    )


def residual_histogram(
    df: DataFrame,
    bins: int = HISTOGRAM_BINS,
    *,
    by: Sequence[str] = BY,
    freq: str = "hour",
    time: str = TIME,
    **grid,
) -> DataFrame:
    """Equal-width bins between the smallest and largest residual; empty bins count 0."""
    known = df.filter(F.col("residual").isNotNull()).select(*by, time, "residual")
    low, high = F.min("residual"), F.max("residual")
    flat = F.when(low == high, 0.5).otherwise(0.0)
    edges = [(low - flat).alias("_low"), (high + flat).alias("_high")]
    inside = attach(known, edges, by=by, freq=freq, time=time, **grid)
    number = F.least(F.width_bucket("residual", F.col("_low"), F.col("_high"), F.lit(bins)), F.lit(bins))
    counts = inside.groupBy(*by, number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = known.groupBy(*by).agg(*edges).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("_high") - F.col("_low")) / bins
    return every.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_low") + width * (F.col("bin") - 1)).alias("bin_start"),
        (F.col("_low") + width * F.col("bin")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def mape_by_hour(df: DataFrame, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    return df.groupBy(*by, F.hour(time).alias("hour")).agg(F.avg("abs_pct_error").alias("mape"))


def worst_and_best_hour(hourly: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Hours with the largest and smallest error; the earliest hour wins ties.

    Errors that agree in nine decimals are equal: means of the same numbers differ in the last bits.
    """
    known, error = F.col("mape").isNotNull(), F.round("mape", 9).alias("mape")
    worst = F.max_by("hour", F.when(known, F.struct(error, -F.col("hour"))))
    best = F.min_by("hour", F.when(known, F.struct(error, "hour")))
    return hourly.groupBy(*by).agg(
        worst.alias("worst_hour"),
        F.max("mape").alias("worst_mape"),
        best.alias("best_hour"),
        F.min("mape").alias("best_mape"),
    )


def mape_by_holiday(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Error on regular days and on holidays; a kind of day that never occurs counts 0."""
    error = F.col("abs_pct_error")
    holiday = F.col("is_holiday") == 1
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(~holiday, error)), F.lit(0.0)).alias("regular_mape"),
        F.coalesce(F.avg(F.when(holiday, error)), F.lit(0.0)).alias("holiday_mape"),
    )
