"""Holiday flags and distances from an explicit holiday table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.calendar import is_weekend
from wattline.names import TIME

# Fixed value: distances are reported up to this many days.
DISTANCE_CAP = 30


def fixed_date_holidays(
    spark: SparkSession, first_year: int, last_year: int, month_days: Sequence[tuple[int, int, str]], country: str
) -> DataFrame:
    """Holiday table of dates that repeat every year."""
    days = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("n")) for m, d, n in month_days]))
    return (
        spark.range(first_year, last_year + 1)
        .select(F.col("id").cast("int").alias("y"), days.alias("h"))
        .select(
            F.lit(country).alias("country"),
            F.make_date("y", "h.m", "h.d").alias("holiday_date"),
            F.col("h.n").alias("name"),
        )
    )


def holiday_dates(holidays: DataFrame, country: str | None = None) -> DataFrame:
    """One row per date that lies within 30 days of a holiday.

    Every holiday is spread over its 61 neighbouring dates, so that the nearest-holiday
    lookup becomes an equi-join on the date instead of a range join.
    """
    if country is not None:
        holidays = holidays.filter(F.col("country") == country)
    offset = F.col("_offset")
    return (
        holidays.select(
            F.to_date("holiday_date").alias("_day"),
            F.explode(F.sequence(F.lit(-DISTANCE_CAP), F.lit(DISTANCE_CAP))).alias("_offset"),
        )
        .groupBy(F.date_add("_day", offset).alias("date"))
        .agg(
            F.max((offset == 0).cast("int")).alias("is_holiday"),
            F.max((offset == -1).cast("int")).alias("is_pre_holiday"),
            F.max((offset == 1).cast("int")).alias("is_post_holiday"),
            F.min(F.when(offset <= 0, -offset)).alias("days_until_holiday"),
            F.min(F.when(offset >= 0, offset)).alias("days_since_holiday"),
        )
    )


def add_holiday_features(
    df: DataFrame, holidays: DataFrame, *, country: str | None = None, time: str = TIME
) -> DataFrame:
    """Weekend, holiday, eve and day-after flags, working day, and holiday distances.

    The date table holds at most 366 rows per calendar year. It is joined without a
    hint: Spark broadcasts it while it measures below its threshold.
    """
    dates = holiday_dates(holidays, country)
    joined = df.join(dates.withColumnRenamed("date", "_date"), F.to_date(F.col(time)) == F.col("_date"), "left")
    weekend = is_weekend(F.col(time))
    flags = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("is_holiday", "is_pre_holiday", "is_post_holiday")}
    distances = {
        c: F.coalesce(F.col(c), F.lit(DISTANCE_CAP)).cast("double")
        for c in ("days_until_holiday", "days_since_holiday")
    }
    working = ((weekend == 0) & (F.coalesce(F.col("is_holiday"), F.lit(0)) == 0)).cast("int")
    return joined.select(
        *df.columns,
        weekend.alias("is_weekend"),
        *[c.alias(n) for n, c in flags.items()],
        working.alias("is_working_day"),
        *[c.alias(n) for n, c in distances.items()],
    )
