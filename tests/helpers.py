"""Small frames and comparisons shared by the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

SCHEMA = "series_id string, datetime timestamp_ntz, demand_mw double, temp_c double, relative_humidity double"


def frame(spark, pdf: pd.DataFrame, schema: str = SCHEMA):
    names = [p.split()[0] for p in schema.split(", ")]
    rows = []
    for row in pdf[names].itertuples(index=False):
        values = []
        for v in row:
            if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT:
                values.append(None)
            elif isinstance(v, pd.Timestamp):
                values.append(v.to_pydatetime())
            elif isinstance(v, np.generic):
                values.append(v.item())
            else:
                values.append(v)
        rows.append(tuple(values))
    return spark.createDataFrame(rows, schema)


def sine_hourly(n: int, start: str = "2023-01-01", series: str = "a", seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    return pd.DataFrame(
        {
            "series_id": series,
            "datetime": pd.date_range(start, periods=n, freq="h"),
            "demand_mw": 4000 + 500 * np.sin(2 * np.pi * i / 24) + rng.normal(0, 50, n),
            "temp_c": 25 + 5 * np.sin(2 * np.pi * i / 24),
            "relative_humidity": 50 + 10 * np.cos(2 * np.pi * i / 24),
        }
    )


def to_sorted_pandas(df, keys=("series_id", "datetime")) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def assert_same(left: pd.DataFrame, right: pd.DataFrame, atol: float = 1e-8) -> None:
    assert list(left.columns) == list(right.columns)
    assert len(left) == len(right)
    for c in left.columns:
        if pd.api.types.is_float_dtype(left[c]):
            np.testing.assert_allclose(
                left[c].to_numpy(float), right[c].to_numpy(float), atol=atol, rtol=1e-10, err_msg=c
            )
        else:
            assert left[c].tolist() == right[c].tolist(), c
