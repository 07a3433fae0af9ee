"""Seasonal naive model: the value one season ago."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lag column per product, and the column used where it is absent.
SEASONAL_COLUMN = {"hour": "lag_168h", "day": "lag_7d"}
FALLBACK_COLUMN = "lag_24h"


def naive_column(columns: list[str], seasonal: str = "lag_168h") -> str:
    for name in (seasonal, FALLBACK_COLUMN):
        if name in columns:
            return name
    raise ValueError(f"neither {seasonal!r} nor {FALLBACK_COLUMN!r} is among the feature columns")


def predict_naive(df: DataFrame, seasonal: str = "lag_168h", output: str = "pred") -> DataFrame:
    return df.withColumn(output, F.col(naive_column(df.columns, seasonal)))
