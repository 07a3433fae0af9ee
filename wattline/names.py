"""Canonical column names and the fixed values every module agrees on."""

from __future__ import annotations

SERIES = "series_id"
TIME = "datetime"
DEMAND = "demand_mw"
TEMP = "temp_c"
HUMIDITY = "relative_humidity"
WEATHER_SOURCE = "weather_source"
SCENARIO = "scenario_id"
STEP = "step"

BY = (SERIES,)
VALUES = (DEMAND, TEMP, HUMIDITY)

# Forecast horizons in hours (next day, next week, next month).
HORIZONS = {"next_day": 24, "next_week": 168, "next_month": 720}

# Labels for where a data set or a weather row came from.
PROVENANCE = ("synthetic_simulated", "real_recorded", "benchmark_hybrid")
WEATHER_SOURCES = ("historical_reanalysis", "climatological_fallback", "nwp_forecast", "climatology")

# Fixed value: degree-day base temperature in Celsius (65 F).
BASE_TEMP_C = 18.33
