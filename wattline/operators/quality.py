"""Data-quality checks: one report row per series, or an error on the first breach."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.names import BY, DEMAND, HUMIDITY, TEMP, TIME

# Rows of one series that are compared in arrival order within one task.


class DataQualityError(ValueError):
    """A data set breaks a quality rule."""


@dataclass(frozen=True)
class Bounds:
    # Physical limits. Demand must lie in (min, max], the others in [min, max].
    min_demand_mw: float = 0.0
    max_demand_mw: float = 20000.0
    min_temp_c: float = -30.0
    max_temp_c: float = 60.0
    min_humidity: float = 0.0
    max_humidity: float = 100.0


def _is_time(df: DataFrame, time: str) -> bool:
    return time in df.columns and isinstance(df.schema[time].dataType, (T.TimestampNTZType, T.TimestampType))


def validate_schema(df: DataFrame, time: str = TIME, target: str = DEMAND) -> bool:
    """True if the time and target columns exist; raises ValueError otherwise."""
    if time not in df.columns:
        raise ValueError(f"data set has no time column {time!r}")
    if target not in df.columns:
        raise ValueError(f"data set is missing the target column {target!r}")
    return True


def schema_report(df: DataFrame, time: str = TIME, target: str = DEMAND) -> DataFrame:
    """One row: number of rows, whether the schema is valid, its time column a timestamp, and the problem if not."""
    try:
        validate_schema(df, time, target)
        check_time_type(df, time)
        problem = None
    except ValueError as error:  # a wrong type is one too
        problem = str(error)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(time in df.columns and target in df.columns).alias("valid"),
        F.lit(_is_time(df, time)).alias("timed"),
        F.lit(problem).cast("string").alias("problem"),
    )


def check_time_type(df: DataFrame, time: str = TIME) -> None:
    if not _is_time(df, time):
        raise DataQualityError(f"{time!r} must be a timestamp column")


def extent(df: DataFrame, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"), F.min(time).alias("start_time"), F.max(time).alias("end_time")
    )


def count_out_of_order(df: DataFrame, seq: str, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Readings that are older than the one that arrived before them, per series.

    ``seq`` is the arrival number, dense or not. Readings are dealt to ranges of series and arrival number, so a hot
    series is cut where it has readings. Each range is compared on its own; one
    row per series and range then settles the borders.
    """
    ranged = df.select(*by, seq, time).repartitionByRange(*by, seq).withColumn("_range", F.spark_partition_id())
    stretch = Window.partitionBy(*by, "_range").orderBy(seq)
    inside = (
        ranged.withColumn("_back", (F.lag(time).over(stretch) > F.col(time)).cast("long"))
        .groupBy(*by, "_range")
        .agg(
            F.coalesce(F.sum("_back"), F.lit(0)).alias("_back"),
            F.min_by(time, seq).alias("_first"),
            F.max_by(time, seq).alias("_last"),
        )
    )
    border = F.lag("_last").over(Window.partitionBy(*by).orderBy("_range")) > F.col("_first")
    return (
        inside.withColumn("_border", F.coalesce(border.cast("long"), F.lit(0)))
        .groupBy(*by)
        .agg(F.sum(F.col("_back") + F.col("_border")).alias("n_out_of_order"))
    )


def count_duplicates(df: DataFrame, *, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Readings beyond the first one of the same time, per series."""
    times = df.groupBy(*by, time).agg(F.count(F.lit(1)).alias("_n"))
    return times.groupBy(*by).agg(F.sum(F.col("_n") - 1).alias("n_duplicates"))


def missing(column: Column) -> Column:
    return column.isNull() | F.isnan(column)


def _is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return missing(F.col(name))
    return F.col(name).isNull()


def _value_columns(df: DataFrame, by: Sequence[str], time: str, seq: str | None) -> list[str]:
    return [c for c in df.columns if c not in (*by, time, seq)]


def count_nulls(df: DataFrame, *, by: Sequence[str] = BY, time: str = TIME, seq: str | None = None) -> DataFrame:
    """Missing values per column, NaN included."""
    columns = _value_columns(df, by, time, seq)
    return df.groupBy(*by).agg(*[F.count_if(_is_missing(df, c)).alias(f"null_{c}") for c in columns])


def count_demand_low(df: DataFrame, bounds: Bounds = Bounds(), *, by: Sequence[str] = BY) -> DataFrame:
    v = F.nanvl(F.col(DEMAND), F.lit(None))
    return df.groupBy(*by).agg(F.count_if(v <= bounds.min_demand_mw).alias("n_low"), F.min(v).alias("demand_min"))


def count_demand_high(df: DataFrame, bounds: Bounds = Bounds(), *, by: Sequence[str] = BY) -> DataFrame:
    v = F.nanvl(F.col(DEMAND), F.lit(None))
    return df.groupBy(*by).agg(F.count_if(v > bounds.max_demand_mw).alias("n_high"), F.max(v).alias("demand_max"))


def _count_outside(df: DataFrame, column: str, low: float, high: float, name: str, by: Sequence[str]) -> DataFrame:
    v = F.nanvl(F.col(column), F.lit(None))
    return df.groupBy(*by).agg(
        F.count_if((v < low) | (v > high)).alias(f"n_{name}_outside"),
        F.min(v).alias(f"{name}_min"),
        F.max(v).alias(f"{name}_max"),
    )


def count_temp_outside(df: DataFrame, bounds: Bounds = Bounds(), *, by: Sequence[str] = BY) -> DataFrame:
    return _count_outside(df, TEMP, bounds.min_temp_c, bounds.max_temp_c, "temp", by)


def count_humidity_outside(df: DataFrame, bounds: Bounds = Bounds(), *, by: Sequence[str] = BY) -> DataFrame:
    return _count_outside(df, HUMIDITY, bounds.min_humidity, bounds.max_humidity, "humidity", by)


def quality_report(
    df: DataFrame,
    bounds: Bounds = Bounds(),
    *,
    allow_missing: bool = False,
    seq: str | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
) -> DataFrame:
    """One row per series with all counts, ``issues`` in the order of the rules, ``passed``.

    The readings are aggregated per time first, which counts the duplicates, and then
    per series. With ``seq`` arrival order is checked too, in a second reading. Readings without a
    series are a series of their own.
    """
    check_time_type(df, time)
    columns = _value_columns(df, by, time, seq)

    def value(name: str) -> Column:
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))

    counts = {f"null_{c}": F.count_if(_is_missing(df, c)) for c in columns}
    lows: dict[str, Column] = {}
    highs: dict[str, Column] = {}
    if DEMAND in columns:
        v = value(DEMAND)
        counts |= {"n_low": F.count_if(v <= bounds.min_demand_mw), "n_high": F.count_if(v > bounds.max_demand_mw)}
        lows["demand_min"], highs["demand_max"] = F.min(v), F.max(v)
    for column, name, low, high in (
        (TEMP, "temp", bounds.min_temp_c, bounds.max_temp_c),
        (HUMIDITY, "humidity", bounds.min_humidity, bounds.max_humidity),
    ):
        if column in columns:
            v = value(column)
            counts[f"n_{name}_outside"] = F.count_if((v < low) | (v > high))
            lows[f"{name}_min"], highs[f"{name}_max"] = F.min(v), F.max(v)
    per_time = df.groupBy(*by, time).agg(
        F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in (counts | lows | highs).items()]
    )
    report = per_time.groupBy(*by).agg(
        F.sum("_n").alias("total_rows"),
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"),
        *[F.sum(n).alias(n) for n in counts],
        *[F.min(n).alias(n) for n in lows],
        *[F.max(n).alias(n) for n in highs],
    )
    if seq is not None:
        order = count_out_of_order(df, seq, by=by, time=time).withColumnsRenamed({k: f"_{k}" for k in by})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
        report = report.join(order, same).drop(*[f"_{k}" for k in by])

    def shown(name: str) -> Column:
        return F.format_string("%.1f", F.col(name))

    rules = []
    if seq is not None:
        rules.append((F.col("n_out_of_order") > 0, F.lit("timestamps are not monotonically increasing")))
    rules.append(
        (F.col("n_duplicates") > 0, F.concat(F.col("n_duplicates").cast("string"), F.lit(" duplicate timestamps")))
    )
    if not allow_missing and columns:
        named = [F.when(F.col(f"null_{c}") > 0, F.lit(c)) for c in columns]
        bad = F.concat_ws(", ", *named)
        rules.append((bad != "", F.concat(F.lit("unresolved missing values in columns: "), bad)))
    if DEMAND in columns:
        rules += [
            (
                F.col("n_low") > 0,
                F.concat(F.col("n_low").cast("string"), F.lit(" non-positive or negative demand values (min="), shown("demand_min"), F.lit(")")),
            ),
            (
                F.col("n_high") > 0,
                F.concat(F.col("n_high").cast("string"), F.lit(" demand values above the ceiling (max="), shown("demand_max"), F.lit(")")),
            ),
        ]
    for column, name in ((TEMP, "temp"), (HUMIDITY, "humidity")):
        if column in columns:
            span = F.concat(shown(f"{name}_min"), F.lit(" to "), shown(f"{name}_max"))
            rules.append(
                (F.col(f"n_{name}_outside") > 0, F.concat(F.lit(f"{column} outside realistic bounds (range: "), span, F.lit(")")))
            )
    issues = F.array_compact(F.array(*[F.when(broken, text) for broken, text in rules]))
    return report.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def validate(df: DataFrame, bounds: Bounds = Bounds(), **kwargs) -> DataFrame:
    """The report, after raising the first issue of the first series that has one."""
    report = quality_report(df, bounds, **kwargs)
    broken = report.filter(~F.col("passed")).select(F.col("issues")[0].alias("issue")).first()
    if broken is not None:
        raise DataQualityError(broken["issue"])
    return report
