"""Weather service payloads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.names import HUMIDITY, TEMP, TIME, WEATHER_SOURCE, WEATHER_SOURCES

# Fixed value: parallel arrays of an hourly weather payload.
PAYLOAD_SCHEMA = (
    "hourly struct<time: array<string>, temperature_2m: array<double>, relative_humidity_2m: array<double>>"
)


def read_weather_payload(df: DataFrame, payload: str | Column = "payload", source: str = "nwp_forecast") -> DataFrame:
    """One row per hour of each payload, tagged with where it came from.

    Other columns of ``df`` (such as a location or series) are kept.
    """
    if source not in WEATHER_SOURCES:
        raise ValueError(f"source must be one of {WEATHER_SOURCES}, got {source!r}")
    column = F.col(payload) if isinstance(payload, str) else payload
    kept = [c for c in df.columns if c != payload]
    hourly = F.from_json(column, PAYLOAD_SCHEMA)["hourly"]
    zipped = F.arrays_zip(
        hourly["time"].alias("time"),
        hourly["temperature_2m"].alias("temperature"),
        hourly["relative_humidity_2m"].alias("humidity"),
    )
    return df.select(*kept, F.explode(zipped).alias("_hour")).select(
        *kept,
        F.to_timestamp_ntz(F.col("_hour.time")).alias(TIME),
        F.col("_hour.temperature").alias(TEMP),
        F.col("_hour.humidity").alias(HUMIDITY),
        F.lit(source).alias(WEATHER_SOURCE),
    )
