"""Timestamps as whole steps on an hourly or daily grid.

A step is the number of whole hours (or days) since 1970-01-01 00:00 of the naive
local clock. All arithmetic stays on TIMESTAMP_NTZ and DATE, so results do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQS = ("hour", "day")


def check_freq(freq: str) -> str:
    if freq not in FREQS:
        raise ValueError(f"freq must be one of {FREQS}, got {freq!r}")
    return freq


def step_of(time: Column, freq: str) -> Column:
    """Step that ``time`` falls into, as BIGINT."""
    days = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("long")
    if check_freq(freq) == "day":
        return days
    return days * 24 + F.hour(time)


def time_of(step: Column, freq: str) -> Column:
    """Start of a step, as TIMESTAMP_NTZ."""
    amount = step.cast("int")
    if check_freq(freq) == "day":
        width = F.make_dt_interval(days=amount)
    else:
        width = F.make_dt_interval(hours=amount)
    return F.lit("1970-01-01").cast("timestamp_ntz") + width


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(F.to_date(later), F.to_date(earlier))
