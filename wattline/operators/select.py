"""Exact quantiles of many series by nested histograms.

``F.percentile`` buffers the distinct values of a series in one task. Here values are counted in ``BUCKETS`` equal
ranges per series, with the least and largest value of each; only the ranges that hold a wanted rank
are cut again, and after ``LEVELS`` cuts the values of those last ranges are counted one by one. Counts are summed
before they are shuffled, series are dealt to several join keys, and windows see one row per range, so a hot series costs a
pass of its rows per level and no task holds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.names import BY

BUCKETS = 1024
LEVELS = 2
_SALTS = 16


def _salted(rows: DataFrame, series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their series' one row."""
    spread = series.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(_SALTS)).cast("int")).join(spread, [*by, "_salt"]).drop("_salt")


def _chosen(counts: DataFrame, by: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Per wanted rank the range that holds it, and the rank inside it."""
    order = Window.partitionBy(*by, "_rank", "_lo").orderBy(low)
    running = counts.withColumns({"_below": F.sum("_n").over(order) - F.col("_n")})
    held = running.where((F.col("_at") >= F.col("_below")) & (F.col("_at") < F.col("_below") + F.col("_n")))
    return held.select(*by, "_rank", (F.col("_at") - F.col("_below")).alias("_at"), low.alias("_lo"), high.alias("_hi"))


def _ranges(wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per series with all its ranges: a handful."""
    return wanted.groupBy(*by).agg(F.collect_list(F.struct("_rank", "_at", "_lo", "_hi")).alias("_ranges"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    fractions: Sequence[float],
    *,
    by: Sequence[str] = BY,
    buckets: int = BUCKETS,
    levels: int = LEVELS,
) -> DataFrame:
    """Per series ``n``, the number of values, and ``quantiles``, interpolated between neighbours.

    Equal to ``F.percentile``: nulls don't count, and a series of nulls has null. NaN is larger than any number.
    ``df`` is read once per level and twice more.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    known = rows.where("_v is not null")
    ends = known.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.array(*[F.floor((F.col("n") - 1) * F.lit(float(f)) + F.lit(k)).cast("long") for f in fractions for k in (0, 1)])
    ranks = F.explode(F.array_distinct(F.transform(places, lambda p: F.least(p, F.col("n") - 1))))
    wanted = ends.select(*by, "_lo", "_hi", ranks.alias("_rank")).select(*by, "_rank", F.col("_rank").alias("_at"), "_lo", "_hi")
    for level in range(levels + 1):
        own = _salted(known, _ranges(wanted, by), by).select(*by, "_v", F.explode("_ranges").alias("_r"))
        own = own.where((F.col("_v") >= F.col("_r._lo")) & (F.col("_v") <= F.col("_r._hi"))).select(*by, "_v", "_r.*")
        if level == levels:  # what is left is counted value by value
            counts = own.groupBy(*by, "_rank", "_at", "_lo", F.col("_v").alias("_low")).agg(F.count("*").alias("_n"), F.max("_v").alias("_high"))
        else:
            # Monotone in the value, so a range holds neighbouring values only, whatever is rounded.
            share = (F.col("_v") / 2 - F.col("_lo") / 2) / F.nullif(F.col("_hi") / 2 - F.col("_lo") / 2, F.lit(0.0))
            bucket = F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(1.0)), F.lit(0.0)) * buckets), F.lit(buckets - 1))
            counts = own.groupBy(*by, "_rank", "_at", "_lo", bucket.alias("_bucket")).agg(
                F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
            )
        wanted = _chosen(counts, by, F.col("_low"), F.col("_high"))
    found = wanted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_values"))
    joined = rows.select(*by).distinct().join(ends.select(*by, "n"), list(by), "left").join(found, list(by), "left")

    def quantile(f: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(f))
        low = F.floor(at)
        a = F.col("_values")[low]
        b = F.col("_values")[F.least(low + 1, F.col("n") - 1)]
        return F.when(a == b, a).otherwise(a * (low + 1 - at) + b * (at - low))

    quantiles = F.when(F.col("n").isNotNull(), F.array(*[quantile(f) for f in fractions]))
    return joined.select(*by, F.coalesce("n", F.lit(0).cast("long")).alias("n"), quantiles.alias("quantiles"))
