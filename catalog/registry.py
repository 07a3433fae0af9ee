"""Registration of queries.

Computed doubles are rounded to six decimals on both sides, because two engines add
numbers up in different orders. A small shift keeps means of two-decimal amounts, which
often end in exactly half a unit of the last place, away from the rounding border.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from wattline.sources.files import checkpoint_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 6
SHIFT = 3.3e-8


def query(name: str, oracle: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query under ``name``; ``doubles`` lists the columns to round."""
    rounded = doubles.split()

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c) + SHIFT, DECIMALS) for c in rounded}) if rounded else out

        run.__name__ = name
        run.__doc__ = build.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle is not None:
            replaced = ", ".join(f"round({c} + {SHIFT}, {DECIMALS}) AS {c}" for c in rounded)
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({oracle})" if rounded else oracle
        return build

    return register


def scratch(spark: SparkSession) -> str:
    """A new folder for tables a query writes.

    It lies in the shared folder that ``spark.checkpoint.dir`` names or, in a session without that
    setting, below its warehouse.
    """
    shared = checkpoint_folder(spark)
    return f"{shared}/wattline-{uuid.uuid4().hex}"
