"""Load-forecasting analytics on Spark DataFrames.

Every operator is a lazy transformation of a table with one row per reading, keyed by
``series_id`` and ``datetime``; one job handles any number of series.
"""
