import numpy as np
import pandas as pd
import pytest

from helpers import assert_same, frame, sine_hourly, to_sorted_pandas
from wattline.operators import clean as C
from wattline.operators.resample import resample_daily_first, resample_daily_mean, resample_mean

VALUES = ["demand_mw", "temp_c", "relative_humidity"]


def gappy(n_series=12, n=60, seed=3) -> pd.DataFrame:
    """Irregular readings: several per hour, long gaps, missing values, own starts."""
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(n_series):
        pdf = sine_hourly(n, start=f"2023-01-{1 + k % 5:02d} 0{k % 7}:00", series=f"s{k}", seed=k)
        for c in VALUES:
            for _ in range(4):
                at, length = rng.integers(0, n), rng.integers(1, 14)
                pdf.loc[at : at + length, c] = np.nan
        keep = rng.random(n) > 0.35
        keep[[0, -1]] = True
        pdf = pdf[keep]
        extra = pdf.sample(10, random_state=k).assign(
            datetime=lambda d: d["datetime"] + pd.Timedelta(minutes=25), demand_mw=lambda d: d["demand_mw"] + 70
        )
        parts += [pdf, extra]
    out = pd.concat(parts, ignore_index=True)
    out.loc[5, "demand_mw"] = 999999.0
    return out


def pandas_grid(pdf):
    return {
        s: g.set_index("datetime").sort_index()[VALUES].resample("1h").mean() for s, g in pdf.groupby("series_id")
    }


def pandas_clip(s):
    v = s.dropna()
    if len(v) > 10:
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        return s.clip(max(0.0, q1 - 3.5 * (q3 - q1)), q3 + 3.5 * (q3 - q1))
    return s.clip(s.quantile(0.001), s.quantile(0.999))


def stack(grids):
    parts = [g.reset_index().assign(series_id=s) for s, g in grids.items()]
    return pd.concat(parts)[["series_id", "datetime", *VALUES]].sort_values(["series_id", "datetime"], ignore_index=True)


@pytest.mark.parametrize("chunk_steps", [5, 17, 32768])
def test_resample_matches_pandas(spark, chunk_steps):
    pdf = gappy()
    got = to_sorted_pandas(resample_mean(frame(spark, pdf), chunk_steps=chunk_steps))
    assert_same(got, stack(pandas_grid(pdf)))


@pytest.mark.parametrize("chunk_steps", [5, 17, 32768])
def test_clean_matches_pandas(spark, chunk_steps):
    pdf = gappy()
    grids = pandas_grid(pdf)
    for g in grids.values():
        g["demand_mw"] = pandas_clip(g["demand_mw"])
        for c in VALUES:
            g[c] = g[c].ffill(limit=4).interpolate("linear").bfill()
    df = frame(spark, pdf)
    want = stack(grids)
    assert_same(to_sorted_pandas(C.clean(df, chunk_steps=chunk_steps)), want)
    grid = dict(chunk_steps=chunk_steps)
    steps = C.fill_gaps(C.clip_outliers(resample_mean(df, **grid), **grid), **grid)
    assert_same(to_sorted_pandas(steps), want)


@pytest.mark.parametrize("chunk_steps", [5, 32768])
@pytest.mark.parametrize(
    "operator, reference",
    [
        (C.ffill, lambda s: s.ffill(limit=4)),
        (C.bfill, lambda s: s.bfill()),
        (C.interpolate_linear, lambda s: s.interpolate("linear")),
        (C.fill_residual, lambda s: s.bfill().ffill()),
    ],
)
def test_single_fills(spark, operator, reference, chunk_steps):
    pdf = stack(pandas_grid(gappy()))
    want = pdf.copy()
    for c in VALUES:
        want[c] = pdf.groupby("series_id")[c].transform(reference)
    got = to_sorted_pandas(operator(frame(spark, pdf), VALUES, chunk_steps=chunk_steps))
    assert_same(got, want)


def test_empty_chunks_between_readings(spark):
    pdf = sine_hourly(200).iloc[[0, 3, 150, 199]]
    want = pandas_grid(pdf)
    for g in want.values():
        g["demand_mw"] = pandas_clip(g["demand_mw"])
        for c in VALUES:
            g[c] = g[c].ffill(limit=4).interpolate("linear").bfill()
    got = to_sorted_pandas(C.clean(frame(spark, pdf), chunk_steps=16))
    assert_same(got, stack(want))


def test_dirty_two_days(spark):
    pdf = sine_hourly(48, start="2024-01-01")
    pdf.loc[[5, 6], "demand_mw"] = np.nan
    pdf.loc[20, "demand_mw"] = 999999.0
    got = to_sorted_pandas(C.clean(frame(spark, pdf)))
    assert len(got) == 48 and not got.isna().any().any() and got["demand_mw"].max() < 10000


def test_small_series_uses_quantile_fences(spark):
    pdf = sine_hourly(8)
    pdf.loc[3, "demand_mw"] = 1e6
    got = C.outlier_bounds(frame(spark, pdf)).first()
    assert got["upper"] == pytest.approx(pdf["demand_mw"].quantile(0.999))
    assert got["lower"] == pytest.approx(pdf["demand_mw"].quantile(0.001))


def test_other_columns(spark):
    pdf = sine_hourly(30).assign(price=np.where(np.arange(30) < 3, np.nan, 1.0 * np.arange(30)), note="x")
    df = frame(
        spark,
        pdf,
        "series_id string, datetime timestamp_ntz, demand_mw double, price double, note string",
    )
    got = to_sorted_pandas(C.clean(df))
    assert list(got.columns) == ["series_id", "datetime", "demand_mw", "price"]
    assert got["price"].tolist()[:4] == [3.0, 3.0, 3.0, 3.0]


def test_time_column_is_required(spark):
    with pytest.raises(ValueError, match="timestamp column"):
        C.clean(spark.createDataFrame([("a", "2024-01-01", 1.0)], "series_id string, datetime string, demand_mw double"))


@pytest.mark.parametrize("chunk_steps", [2, 32768])
def test_daily(spark, chunk_steps):
    pdf = gappy(n_series=4, n=200)
    pdf = pdf[pdf["datetime"].dt.day != 6].assign(weather_source=lambda d: np.where(d["datetime"].dt.hour < 3, None, "x" + d["datetime"].dt.hour.astype(str)))
    df = frame(spark, pdf, "series_id string, datetime timestamp_ntz, demand_mw double, temp_c double, relative_humidity double, weather_source string")
    want = pd.concat(
        [g.set_index("datetime").sort_index()[VALUES].resample("1D").mean().reset_index().assign(series_id=s) for s, g in pdf.groupby("series_id")]
    )[["series_id", "datetime", *VALUES]].sort_values(["series_id", "datetime"], ignore_index=True)
    assert_same(to_sorted_pandas(resample_daily_mean(df, chunk_steps=chunk_steps)), want)
    first = pd.concat(
        [g.set_index("datetime").sort_index()["weather_source"].resample("1D").first().reset_index().assign(series_id=s) for s, g in pdf.groupby("series_id")]
    ).sort_values(["series_id", "datetime"], ignore_index=True)
    got = to_sorted_pandas(resample_daily_first(df, chunk_steps=chunk_steps))
    assert got["weather_source"].tolist() == [None if x is None or x != x else x for x in first["weather_source"]]


def test_fills_scan_and_deal_their_rows_once(spark, tmp_path):
    path = str(tmp_path / "grid")
    frame(spark, sine_hourly(500)).write.parquet(path)
    df = spark.read.parquet(path)
    for filled in (C.ffill(df), C.interpolate_linear(df), C.bfill(df), C.fill_gaps(df, ["temp_c"]), C.fill_residual(df, ["demand_mw", "temp_c"])):
        filled.collect()
        plan = filled._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
