"""Reading and writing the tables of the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.names import BY, DEMAND, HUMIDITY, PROVENANCE, SERIES, TEMP, TIME
from wattline.operators.quality import validate_schema

SERIES_SCHEMA = "datetime timestamp_ntz, demand_mw double, temp_c double, relative_humidity double"

_INTERVALS = (
    "forecast_mw double, lower_bound_80 double, upper_bound_80 double, lower_bound_90 double, upper_bound_90 double, "
    "lower_bound_95 double, upper_bound_95 double, uncertainty_sigma_mw double"
)
# Columns of the forecast files, in file order.
FORECAST_SCHEMAS = {
    "next_day": f"{_INTERVALS}, datetime timestamp_ntz, hour int, day_of_week int, temp_c double, "
    "relative_humidity double, weather_source string",
    "next_week": f"{_INTERVALS}, datetime timestamp_ntz, temp_c double, relative_humidity double, weather_source string",
    "next_week_daily": "datetime timestamp_ntz, forecast_mean_mw double, peak_mw double, min_mw double, "
    "total_gwh double, temp_c double, relative_humidity double, lower_bound_mw double, upper_bound_mw double, "
    "day_of_week string, is_weekend int, is_holiday int, day_over_day_change_mw double",
    "next_month": f"{_INTERVALS}, datetime timestamp_ntz, day_of_week string, is_weekend int, is_holiday int, "
    "temp_c double, relative_humidity double, weather_source string, total_daily_gwh double",
}


# Texts that stand for a missing number in CSV files.
MISSING_MARKS = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _number(name: str) -> Column:
    """A text column as numbers; a mark for a missing value is null, anything else that is no number raises."""
    text = F.trim(F.col(name))
    return F.when(~text.isin(*MISSING_MARKS), text).cast("double")


def read_csv_series(
    spark: SparkSession,
    path: str,
    *,
    date_col: str = TIME,
    demand_col: str = DEMAND,
    temp_col: str | None = TEMP,
    humidity_col: str | None = HUMIDITY,
    series_col: str | None = None,
    series: str = "default",
) -> DataFrame:
    """Recorded series from CSV files, with the file's own column names mapped.

    Only the canonical columns are kept. A file that does not exist raises
    FileNotFoundError, a missing date or demand column KeyError. Rows stay in the
    order of their files: order is a property of windows and sinks, not of tables.
    """
    raw = _read_text_columns(spark, path)
    for role, name in (("date", date_col), ("demand", demand_col)):
        if name not in raw.columns:
            raise KeyError(f"{role} column {name!r} not found in CSV columns: {raw.columns}")
    label = F.col(series_col) if series_col else F.lit(series)
    columns = [label.alias(SERIES), F.to_timestamp_ntz(F.col(date_col)).alias(TIME), _number(demand_col).alias(DEMAND)]
    for name, canonical in ((temp_col, TEMP), (humidity_col, HUMIDITY)):
        if name and name in raw.columns:
            columns.append(_number(name).alias(canonical))
    out = raw.select(*columns)
    validate_schema(out)
    return out


def _read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    # Without a schema or inference every column is a string and only the header is read.
    try:
        # Files of a folder must agree on their header.
        return spark.read.option("header", True).option("enforceSchema", False).csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"input file does not exist: {path}") from error
        raise


def read_cached_series(spark: SparkSession, path: str, **columns) -> DataFrame:
    """A series table in canonical columns, as ``write_csv`` stores it."""
    return read_csv_series(spark, path, **columns)


def read_forecast_csv(spark: SparkSession, path: str, product: str) -> DataFrame:
    """One of the four forecast files."""
    return spark.read.option("header", True).schema(FORECAST_SCHEMAS[product]).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Store a stage as Parquet. Partition by a coarse column only, such as the year:
    one folder per series makes too many small files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> str:
    """Store as CSV with a header. With ``order_by`` the files follow that order."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def with_provenance(df: DataFrame, label: str = PROVENANCE[1]) -> DataFrame:
    if label not in PROVENANCE:
        raise ValueError(f"provenance must be one of {PROVENANCE}, got {label!r}")
    return df.withColumn("data_provenance", F.lit(label))


def dataset_metadata(
    df: DataFrame,
    *,
    dataset_name: str = "custom_recorded_grid",
    provenance: str = PROVENANCE[1],
    by: Sequence[str] = BY,
    time: str = TIME,
) -> DataFrame:
    """One row per series: origin, extent and number of readings."""
    return with_provenance(
        df.groupBy(*by).agg(
            F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count(F.lit(1)).alias("n_rows")
        ),
        provenance,
    ).withColumn("dataset_name", F.lit(dataset_name))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, set as the checkpoint folder where none is set.

    It is ``spark.checkpoint.dir``; a session without that setting uses a folder below its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder
