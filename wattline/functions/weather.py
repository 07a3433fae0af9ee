"""Weather expressions: degree days, heat index, climatology."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.names import BASE_TEMP_C

# Rothfusz heat-index regression in Fahrenheit, as (coefficient, power of
# the temperature, power of the relative humidity), and the temperature it starts at.
ROTHFUSZ = (
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-0.00683783, 2, 0),
    (-0.05481717, 0, 2),
    (0.00122874, 2, 1),
    (0.00085282, 1, 2),
    (-0.00000199, 2, 2),
)
HEAT_INDEX_FROM_F = 80.0


def cooling_degrees(temp: Column, base: float = BASE_TEMP_C) -> Column:
    return F.when(temp.isNotNull(), F.greatest(temp - base, F.lit(0.0)))


def heating_degrees(temp: Column, base: float = BASE_TEMP_C) -> Column:
    return F.when(temp.isNotNull(), F.greatest(F.lit(base) - temp, F.lit(0.0)))


def heat_index(temp: Column, humidity: Column) -> Column:
    """Apparent temperature in Celsius; equal to ``temp`` below 80 F."""
    fahrenheit = temp * 1.8 + 32.0
    total = F.lit(0.0)
    for coefficient, t_power, h_power in ROTHFUSZ:
        term = F.lit(coefficient)
        for factor, power in ((fahrenheit, t_power), (humidity, h_power)):
            for _ in range(power):
                term = term * factor
        total = total + term
    return F.when(fahrenheit >= HEAT_INDEX_FROM_F, (total - 32.0) / 1.8).otherwise(temp)


def temp_humidity(temp: Column, humidity: Column) -> Column:
    return temp * (humidity / 100.0)


@dataclass(frozen=True)
class Climatology:
    """Seasonal weather profile: an annual and a diurnal wave, and a humid season.

    ``temp_offset`` and ``humidity_offset`` shift the whole profile. They default to
    zero, where a profile without random turbulence is wanted.
    """

    # Defaults of the profile.
    annual_mean_temp: float = 26.5
    annual_temp_amplitude: float = 11.5
    daily_temp_amplitude: float = 4.5
    summer_peak_day: int = 150
    monsoon_start_day: int = 180
    monsoon_end_day: int = 270
    temp_offset: float = 0.0
    humidity_offset: float = 0.0

    def _raw_temp(self, time: Column) -> Column:
        # A quarter of a year lies between the mean and the peak of the annual wave.
        day = F.dayofyear(time) - (self.summer_peak_day - 91)
        annual = F.sin(day * F.lit(2 * math.pi) / F.lit(365.25))
        diurnal = F.sin((F.hour(time) - 9) * F.lit(2 * math.pi) / F.lit(24.0))
        return (
            annual * self.annual_temp_amplitude
            + self.annual_mean_temp
            + diurnal * self.daily_temp_amplitude
            + self.temp_offset
        )

    def temp(self, time: Column) -> Column:
        return F.round(self._raw_temp(time), 2)

    def humidity(self, time: Column) -> Column:
        # Humidity at 0 C, slope per degree, humid-season surplus, limits.
        humid = F.dayofyear(time).between(self.monsoon_start_day, self.monsoon_end_day)
        raw = (
            F.lit(82.0)
            - self._raw_temp(time) * 1.25
            + F.when(humid, 22.0).otherwise(0.0)
            + self.humidity_offset
        )
        return F.round(F.least(F.greatest(raw, F.lit(15.0)), F.lit(98.0)), 2)
