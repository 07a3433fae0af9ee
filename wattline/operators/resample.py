"""Dense hourly and daily grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.grid import step_of, time_of
from wattline.names import BY, TIME, VALUES, WEATHER_SOURCE
from wattline.operators.chunks import CHUNK_COL, CHUNK_STEPS, STEP_COL, chunk_of


def keyed(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Readings that have a series and a time.

    Stated as plain conditions, so that they reach the scan and every branch of a plan
    that uses the same readings stays identical and shares one exchange.
    """
    for c in (*by, time):
        df = df.filter(F.col(c).isNotNull())
    return df


def resample(
    df: DataFrame,
    aggregates: Sequence[Column],
    *,
    by: Sequence[str] = BY,
    freq: str,
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Aggregate readings to grid steps and add the empty steps in between as nulls.

    Readings are pre-aggregated before they are shuffled, so a hot series costs one
    partial row per step and task. Only filled steps are shuffled a second time; the
    empty ones are generated after it, next to the reading they follow.
    """
    readings = keyed(df, by, time)
    step = step_of(F.col(time), freq)
    filled = readings.groupBy(*by, step.alias(STEP_COL)).agg(*aggregates)
    names = [c for c in filled.columns if c not in by and c != STEP_COL]

    # One marker per chunk a series spans. It opens the chunk and says where it ends.
    span = readings.groupBy(*by).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    chunk_start = F.col(CHUNK_COL) * chunk_steps
    markers = span.withColumn(
        CHUNK_COL,
        F.explode(F.sequence(chunk_of(F.col("_lo"), chunk_steps), chunk_of(F.col("_hi"), chunk_steps))),
    ).select(
        *by,
        CHUNK_COL,
        F.greatest("_lo", chunk_start).alias(STEP_COL),
        F.least(F.col("_hi"), chunk_start + chunk_steps - 1).alias("_until"),
    )
    rows = filled.withColumn(CHUNK_COL, chunk_of(F.col(STEP_COL), chunk_steps)).unionByName(
        markers, allowMissingColumns=True
    )
    ordered = Window.partitionBy(*by, CHUNK_COL).orderBy(STEP_COL, F.col("_until").isNull())
    until = F.first("_until").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    following = F.lead(STEP_COL).over(ordered)
    covered = rows.withColumn("_last", F.coalesce(following - 1, until)).filter(F.col("_last") >= F.col(STEP_COL))
    return covered.withColumn("_at", F.explode(F.sequence(STEP_COL, "_last"))).select(
        *by,
        time_of(F.col("_at"), freq).alias(time),
        *[F.when(F.col("_at") == F.col(STEP_COL), F.col(n)).alias(n) for n in names],
    )


def not_nan(column: str) -> Column:
    """A double column with NaN read as null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def resample_mean(
    df: DataFrame, values: Sequence[str] = VALUES, *, freq: str = "hour", **grid
) -> DataFrame:
    """Dense grid of means; an empty step, or one with only missing values, is null."""
    return resample(df, [F.avg(not_nan(v)).alias(v) for v in values], freq=freq, **grid)


def resample_daily_mean(df: DataFrame, values: Sequence[str] = VALUES, **grid) -> DataFrame:
    """Calendar-day means on a dense daily grid."""
    return resample_mean(df, values, freq="day", **grid)


def first_label(label: str, time: str = TIME) -> Column:
    """Aggregate: the label with the smallest time, ignoring missing labels."""
    return F.min_by(F.col(label), F.when(F.col(label).isNotNull(), F.col(time))).alias(label)


def resample_daily_first(df: DataFrame, label: str = WEATHER_SOURCE, *, time: str = TIME, **grid) -> DataFrame:
    """First non-null label of each calendar day on a dense daily grid."""
    return resample(df, [first_label(label, time)], freq="day", time=time, **grid)
