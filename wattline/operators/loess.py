"""Seasonal-trend decomposition by Loess on dense grids.

On a regular grid a Loess window has the same tricube weights everywhere but at the two ends of a series, so
smoothing is a fixed filter, with own weights for the first and last half window. All filters of the inner loop reach a
known number of steps. A chunk of a series with a halo of that many steps on both sides therefore has
the values of the whole series, and only chunks that hold an end of the series see its weights: one pass, one shuffle,
no task with more than a chunk and its halos.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.names import BY, DEMAND, TIME
from wattline.operators.chunks import CHUNK_COL, CHUNK_STEPS, HOME_COL, STEP_COL, halo

# Steps of a season, width of the seasonal window in seasons, and rounds of the inner loop.
PERIOD = 24
SEASONAL = 7
ROUNDS = 5


def _odd_above(x: float) -> int:
    """The smallest odd number above ``x``."""
    n = int(np.floor(x)) + 1
    return n if n % 2 else n + 1


def trend_window(period: int, seasonal: int) -> int:
    return _odd_above(1.5 * period / (1.0 - 1.5 / seasonal) - 1e-9)


def _weights(at: float, low: int, high: int, extra: float) -> np.ndarray:
    """Weights of points ``low`` to ``high`` in a local line fitted at ``at``."""
    x = np.arange(low, high + 1, dtype=float)
    reach = max(at - low, high - at) + extra
    w = (1.0 - np.minimum(np.abs(x - at) / reach, 1.0) ** 3) ** 3 if reach > 0 else np.ones(len(x))
    w = w / w.sum()
    mean = w @ x
    spread = w @ (x - mean) ** 2
    return w * (1.0 + (at - mean) * (x - mean) / spread) if spread > 1e-12 else w


def smooth(y: np.ndarray, width: int, beyond: int = 0) -> np.ndarray:
    """Local lines over the ``width`` nearest points of each row of ``y``, with ``beyond`` points added at both ends."""
    n, half = y.shape[1], width // 2
    extra = max(width - n, 0) / 2.0
    size = min(width, n)
    out = np.empty((len(y), n + 2 * beyond))
    if n > 2 * half:
        inner = _weights(half, 0, 2 * half, 0.0)[::-1]
        out[:, beyond + half : beyond + n - half] = np.stack([np.convolve(row, inner, "valid") for row in y])
        edges = [*range(-beyond, half), *range(n - half, n + beyond)]
    else:
        edges = range(-beyond, n + beyond)
    for at in edges:
        low = min(max(at - half, 0), n - size)
        out[:, beyond + at] = y[:, low : low + size] @ _weights(at, low, low + size - 1, extra)
    return out


def _mean(y: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(y)))
    return (total[width:] - total[:-width]) / width


def decompose(y: np.ndarray, period: int, seasonal: int, trend: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part of one stretch of at least two seasons."""
    n, low = len(y), _odd_above(period)
    level, season = np.zeros(n), np.zeros(n)
    base = y.mean()  # running sums stay small
    y = y - base
    for _ in range(rounds):
        cycle = np.empty(n + 2 * period)
        for length in {len(range(p, n, period)) for p in range(period)}:
            phases = [p for p in range(period) if len(range(p, n, period)) == length]
            parts = smooth(np.stack([(y - level)[p::period] for p in phases]), seasonal, beyond=1)
            for p, part in zip(phases, parts, strict=True):
                cycle[p::period] = part
        slow = smooth(_mean(_mean(_mean(cycle, period), period), 3)[None], low)[0]
        season = cycle[period : period + n] - slow
        level = smooth((y - season)[None], trend)[0]
    return level + base, season


def reach(period: int, seasonal: int, trend: int, rounds: int) -> int:
    """Steps that a value depends on to either side."""
    return rounds * (seasonal // 2 * period + period + 1 + _odd_above(period) // 2 + trend // 2) + period


def stl_decompose(
    df: DataFrame,
    period: int = PERIOD,
    value: str = DEMAND,
    *,
    freq: str = "hour",
    seasonal: int = SEASONAL,
    trend: int | None = None,
    rounds: int = ROUNDS,
    by: Sequence[str] = BY,
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Additive parts ``trend``, ``seasonal`` and ``resid`` of a dense grid without gaps.

    Windows are ``seasonal`` seasons, the smallest odd number of steps above a period for the low pass, and ``trend`` steps
    (by default the smallest odd number above 1.5 periods / (1 - 1.5 / seasonal)). Without robustness weights. The parts of a
    series of fewer than two seasons, or near a null, are null.
    """
    if seasonal % 2 == 0 or seasonal < 3:
        raise ValueError("the seasonal window is an odd number of seasons, three at least")
    width = trend or trend_window(period, seasonal)
    far = reach(period, seasonal, width, rounds)
    keys = [*by, CHUNK_COL]
    near = halo(df.select(*by, time, value), far, far, freq=freq, time=time, chunk_steps=chunk_steps)

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(STEP_COL)
        y = pdf[value].to_numpy(float)
        pdf["trend"], pdf["seasonal"] = decompose(y, period, seasonal, width, rounds) if len(y) >= 2 * period else (np.nan, np.nan)
        own = pdf[pdf[HOME_COL] == pdf[CHUNK_COL]]
        return own.assign(resid=own[value] - own["trend"] - own["seasonal"])[[*by, time, value, "trend", "seasonal", "resid"]]

    fields = [f for f in near.schema if f.name in (*by, time, value)]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in ("trend", "seasonal", "resid")]])
    out = near.groupBy(*keys).applyInPandas(parts, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("trend", "seasonal", "resid")})
