import numpy as np
import pandas as pd
import pytest

from helpers import frame, sine_hourly, to_sorted_pandas
from wattline.operators.loess import decompose, reach, smooth, stl_decompose, trend_window


def local_line(y, width, at):
    """Weighted least squares over the nearest points, one position."""
    n = len(y)
    low = min(max(at - width // 2, 0), max(n - width, 0))
    x = np.arange(low, min(low + width, n))
    far = max(abs(x[0] - at), abs(x[-1] - at)) + max(width - n, 0) / 2
    w = np.clip(1 - (np.abs(x - at) / far) ** 3, 0, None) ** 3
    a = np.stack([np.ones(len(x)), x - at], 1) * np.sqrt(w)[:, None]
    return np.linalg.lstsq(a, y[x] * np.sqrt(w), rcond=None)[0][0]


def plain(y, period, seasonal, trend, rounds=5):
    n = len(y)
    level = np.zeros(n)
    for _ in range(rounds):
        cycle = np.empty(n + 2 * period)
        for p in range(period):
            part = (y - level)[p::period]
            cycle[p::period] = [local_line(part, seasonal, at) for at in range(-1, len(part) + 1)]
        mean = lambda v, k: np.array([v[i : i + k].mean() for i in range(len(v) - k + 1)])
        slow = mean(mean(mean(cycle, period), period), 3)
        low = period + 1 + period % 2
        season = cycle[period : period + n] - [local_line(slow, low, at) for at in range(n)]
        level = np.array([local_line(y - season, trend, at) for at in range(n)])
    return level, season


@pytest.mark.parametrize(("n", "width"), [(40, 7), (40, 25), (9, 7), (5, 7), (2, 7), (25, 25), (24, 25)])
def test_smoothing_is_a_local_line(n, width):
    y = np.random.default_rng(n).normal(size=n).cumsum()
    want = [local_line(y, width, at) for at in range(-1, n + 1)]
    np.testing.assert_allclose(smooth(y[None], width, 1)[0], want, atol=1e-9)


@pytest.mark.parametrize(("n", "period"), [(60, 6), (61, 7), (14, 7), (200, 24)])
def test_parts_equal_plain_least_squares(n, period):
    rng = np.random.default_rng(n)
    y = 4000 + np.arange(n) * 3 + 50 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(0, 5, n)
    trend = trend_window(period, 7)
    for got, want in zip(decompose(y, period, 7, trend, 5), plain(y, period, 7, trend), strict=True):
        np.testing.assert_allclose(got, want, atol=1e-7)


def test_windows():
    assert trend_window(24, 7) == 47
    assert reach(24, 7, 47, 5) < 700


@pytest.mark.parametrize("chunk", [50, 333, 700, 32_768])
def test_chunks_have_the_values_of_the_whole_series(spark, chunk):
    pdf = pd.concat([sine_hourly(1500), sine_hourly(900, "2022-12-05 07:00", "b", 3)])
    got = to_sorted_pandas(stl_decompose(frame(spark, pdf), chunk_steps=chunk, rounds=2))
    for name, part in pdf.groupby("series_id"):
        level, season = decompose(part.demand_mw.to_numpy(), 24, 7, 47, 2)
        mine = got[got.series_id == name]
        np.testing.assert_allclose(mine.trend, level, atol=1e-6)
        np.testing.assert_allclose(mine.seasonal, season, atol=1e-6)
        np.testing.assert_allclose(mine.trend + mine.seasonal + mine.resid, part.demand_mw, atol=1e-6)


def test_short_gaps_and_wrong_windows(spark):
    got = stl_decompose(frame(spark, sine_hourly(40)))
    assert got.count() == 40 and got.filter("trend is null and seasonal is null and resid is null").count() == 40
    pdf = sine_hourly(100)
    pdf.loc[50, "demand_mw"] = np.nan
    assert stl_decompose(frame(spark, pdf)).filter("trend is null").count() > 0
    assert stl_decompose(frame(spark, pdf).limit(0)).count() == 0
    with pytest.raises(ValueError, match="odd"):
        stl_decompose(frame(spark, pdf), seasonal=4)
