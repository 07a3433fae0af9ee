"""Calendar, cyclical and label expressions on a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.names import TIME

# Hours of the morning and evening peak and of the night valley.
PEAK_HOURS = ((9, 11), (18, 22))
VALLEY_HOURS = (1, 5)
YEAR_DAYS = 365.25

# Feature names, in matrix order.
CLOCK_NAMES = ("hour", "is_peak_hour", "is_night_valley")
DATE_NAMES = (
    "day_of_week",
    "day_of_month",
    "day_of_year",
    "week_of_year",
    "month",
    "quarter",
    "year",
    "season",
    "annual_position",
)


def is_peak_hour(time: Column) -> Column:
    hour = F.hour(time)
    return (hour.between(*PEAK_HOURS[0]) | hour.between(*PEAK_HOURS[1])).cast("int")


def is_night_valley(time: Column) -> Column:
    return F.hour(time).between(*VALLEY_HOURS).cast("int")


def is_weekend(time: Column) -> Column:
    return (F.weekday(time) >= 5).cast("int")


def season(time: Column) -> Column:
    """1 = Dec-Feb, 2 = Mar-May, 3 = Jun-Aug, 4 = Sep-Nov."""
    return (F.floor((F.month(time) % 12) / 3) + 1).cast("int")


def day_name(time: Column) -> Column:
    return F.date_format(time, "EEEE")


def temporal_names(freq: str) -> list[str]:
    return [*CLOCK_NAMES, *DATE_NAMES] if freq == "hour" else list(DATE_NAMES)


def fourier_names(freq: str) -> list[str]:
    turns = ("hour", "week", "year") if freq == "hour" else ("week", "year")
    return [f"{fn}_{turn}" for turn in turns for fn in ("sin", "cos")]


def temporal_columns(freq: str, time: str = TIME) -> dict[str, Column]:
    """Clock and calendar parts. Monday is day 0; weeks are ISO weeks."""
    t = F.col(time)
    parts = {
        "hour": F.hour(t),
        "is_peak_hour": is_peak_hour(t),
        "is_night_valley": is_night_valley(t),
        "day_of_week": F.weekday(t),
        "day_of_month": F.dayofmonth(t),
        "day_of_year": F.dayofyear(t),
        "week_of_year": F.weekofyear(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "year": F.year(t),
        "season": season(t),
        "annual_position": F.dayofyear(t) / F.lit(YEAR_DAYS),
    }
    return {name: parts[name] for name in temporal_names(freq)}


def _turn(position: Column, period: float) -> Column:
    return position * F.lit(2 * math.pi) / F.lit(float(period))


def fourier_columns(freq: str, time: str = TIME) -> dict[str, Column]:
    """Sine and cosine of the position in the day, week and year."""
    t = F.col(time)
    turns = {
        "week": _turn(F.weekday(t), 7),
        "year": _turn(F.dayofyear(t), YEAR_DAYS),
    }
    if freq == "hour":
        turns = {"hour": _turn(F.hour(t), 24)} | turns
    return {f"{fn}_{name}": getattr(F, fn)(turn) for name, turn in turns.items() for fn in ("sin", "cos")}
