"""From raw readings to stored feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wattline.names import BY, VALUES
from wattline.operators.clean import clean
from wattline.operators.features import DAILY, HOURLY, FeatureSpec, feature_matrix
from wattline.operators.resample import resample_daily_mean
from wattline.sources.files import read_table, write_table


def prepare(raw: DataFrame, path: str, *, by: Sequence[str] = BY) -> str:
    """Clean raw readings and store the dense hourly grid."""
    return write_table(clean(raw, by=by), f"{path}/hourly_demand")


def _store_matrix(
    grid: DataFrame, holidays: DataFrame, path: str, spec: FeatureSpec, country: str | None, by: Sequence[str]
) -> str:
    return write_table(feature_matrix(grid, holidays, freq=spec.freq, spec=spec, country=country, by=by), path)


def build_features(
    spark: SparkSession,
    path: str,
    holidays: DataFrame,
    *,
    country: str | None = None,
    by: Sequence[str] = BY,
    hourly: FeatureSpec = HOURLY,
    daily: FeatureSpec = DAILY,
) -> tuple[DataFrame, DataFrame]:
    """Read the stored grid, write the hourly and the daily feature matrix, return both."""
    grid = read_table(spark, f"{path}/hourly_demand")
    _store_matrix(grid, holidays, f"{path}/features", hourly, country, by)
    values = [c for c in VALUES if c in grid.columns]
    _store_matrix(resample_daily_mean(grid, values, by=by), holidays, f"{path}/features_daily", daily, country, by)
    return read_table(spark, f"{path}/features"), read_table(spark, f"{path}/features_daily")
