import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators.clean import outlier_bounds
from wattline.operators.select import exact_quantiles

FRACTIONS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, series):
    rows = [(name, None if v is None else float(v)) for name, values in series.items() for v in values]
    return spark.createDataFrame(rows, "series_id string, demand_mw double").repartition(3)


def made():
    rng = np.random.default_rng(7)
    return {
        "normal": rng.normal(100, 5, 3000).tolist(),
        "outlier": [*rng.normal(0, 1, 400).tolist(), 1e300, -1e300, 1e-300],
        "ties": [5.0] * 900 + [6.0] * 100,
        "one": [42.0],
        "two": [1.0, 2.0],
        "equal": [3.0] * 50,
        "gaps": [1.0, None, 9.0, None, 4.0],
        "null": [None, None],
        "spread": (10.0 ** rng.uniform(-9, 9, 500)).tolist(),
    }


@pytest.mark.parametrize(("buckets", "levels"), [(1024, 2), (4, 3), (2, 1), (7, 0)])
def test_equal_to_the_exact_percentile(spark, buckets, levels):
    df = frame(spark, made())
    got = {r["series_id"]: r for r in exact_quantiles(df, "demand_mw", FRACTIONS, buckets=buckets, levels=levels).collect()}
    want = df.groupBy("series_id").agg(F.count("demand_mw").alias("n"), F.percentile("demand_mw", FRACTIONS).alias("q")).collect()
    assert len(got) == len(want)
    for r in want:
        mine = got[r["series_id"]]
        assert mine["n"] == r["n"] and (mine["quantiles"] is None) == (r["q"] is None), r
        if r["q"] is not None:
            np.testing.assert_allclose(mine["quantiles"], r["q"], rtol=1e-12)


def test_empty_table_and_bounds(spark):
    df = frame(spark, made())
    assert exact_quantiles(df.limit(0), "demand_mw", FRACTIONS).count() == 0
    one, two = (sorted(outlier_bounds(df, mode=m, selection=s).collect()) for m, s in (("auto", "buffer"), ("auto", "histogram")))
    for a, b in zip(one, two, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y if x is None or isinstance(x, (str, int)) else y == pytest.approx(x, rel=1e-12)
    with pytest.raises(ValueError, match="selection"):
        outlier_bounds(df, selection="guess")
