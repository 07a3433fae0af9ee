"""Registered queries against their SQL, on the smallest driver tables."""

import duckdb
import pytest

from conftest import TESTDATA

import __spark_entry__ as contract

TABLES = ("events", "orders", "lineitem")
SAMPLE = (
    "build_features",
    "clean",
    "cv_evaluate",
    "dq_report",
    "dq_report_broken",
    "feat_holiday_distance",
    "features_daily",
    "forecast_all",
    "forecast_next_month",
    "kpi_week",
    "lag_hourly_annual",
    "metric_horizon_segments",
    "metric_nan",
    "residual_histogram",
    "resample_daily_first",
    "roll_720h",
    "scan_csv_missing",
    "seasonal_decompose",
    "unserved_series",
    "wx_horizon_fill",
)

pytestmark = pytest.mark.skipif(not (TESTDATA / "sf0.001").exists(), reason="driver tables not found")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = contract.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got, want = _rows(df.columns, df.collect()), _rows(columns, result.fetchall())
    assert len(got) > 0 and got == want


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert contract.entry(spark).columns[:2] == ["series_id", "mape"]
