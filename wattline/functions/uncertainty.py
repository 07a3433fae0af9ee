"""Forecast spread that grows with lead time, and the intervals drawn from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.names import STEP

# Normal quantiles of the 80, 90 and 95 % two-sided intervals.
Z_SCORES = {80: 1.282, 90: 1.645, 95: 1.960}


@dataclass(frozen=True)
class Uncertainty:
    """``sigma(h) = base * sqrt(1 + alpha * (max(h, 1) / 24) ** gamma)``.

    ``h`` is the 1-based step times ``step_hours``. The daily product also counts one
    step as one hour, which is what its published intervals use.
    """

    base_sigma_mw: float = 145.0
    alpha: float = 0.45
    gamma: float = 0.65
    step_hours: float = 1.0

    def sigma(self, step: Column) -> Column:
        days = F.greatest(step * F.lit(self.step_hours), F.lit(1.0)) / F.lit(24.0)
        return F.sqrt(F.pow(days, F.lit(self.gamma)) * self.alpha + 1.0) * self.base_sigma_mw

    def attach_intervals(
        self, df: DataFrame, forecast: str = "forecast_mw", step: str = STEP, decimals: int | None = 2
    ) -> DataFrame:
        """Add nested 80/90/95 % bounds and sigma; lower bounds stop at zero."""
        point, sigma = F.col(forecast), self.sigma(F.col(step))

        def shown(c: Column) -> Column:
            return c if decimals is None else F.round(c, decimals)

        out = {forecast: shown(point)}
        for level, z in Z_SCORES.items():
            low = F.when(point.isNotNull(), F.greatest(point - sigma * z, F.lit(0.0)))
            out[f"lower_bound_{level}"] = shown(low)
            out[f"upper_bound_{level}"] = shown(point + sigma * z)
        return df.withColumns(out | {"uncertainty_sigma_mw": shown(sigma)})


# Spread used by the hourly and by the daily forecast products.
HOURLY_UNCERTAINTY = Uncertainty(base_sigma_mw=130.0, alpha=0.35)
DAILY_UNCERTAINTY = Uncertainty(base_sigma_mw=110.0, alpha=0.40)
