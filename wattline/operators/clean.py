"""Clipping of outliers and filling of gaps on a dense grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.grid import step_of, time_of
from wattline.names import BY, DEMAND, HUMIDITY, TEMP, TIME
from wattline.operators.chunks import (
    CHUNK_COL,
    CHUNK_STEPS,
    STEP_COL,
    attach,
    chunk_of,
    chunk_window,
    with_chunk,
)
from wattline.operators.resample import keyed, not_nan
from wattline.operators.select import exact_quantiles

# Fence width in interquartile ranges, the smallest sample that gets
# such fences, the quantile fences below that, and the longest forward fill.
IQR_FACTOR = 3.5
IQR_MIN_VALUES = 10
QUANTILE_FENCES = (0.001, 0.999)
FRACTIONS = [0.25, 0.75, *QUANTILE_FENCES]
FFILL_LIMIT = 4


def has_time_column(df: DataFrame, time: str = TIME) -> bool:
    fields = {f.name: f.dataType for f in df.schema.fields}
    return isinstance(fields.get(time), (T.TimestampNTZType, T.TimestampType))


def check_time_column(df: DataFrame, time: str = TIME) -> None:
    """Raise unless ``time`` is a timestamp column."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if not has_time_column(df, time):
        raise ValueError(f"input needs a timestamp column {time!r}, found {fields.get(time)}")


def _fence_inputs(value: str, accuracy: int | None) -> list[Column]:
    # The exact percentile buffers one entry per distinct value of a series, and a
    # gridded series has at most one value per step (8,784 hours a year). Pass
    # ``accuracy`` for an approximate sketch of fixed size instead.
    if accuracy is None:
        quantiles = F.percentile(F.col(value), FRACTIONS)
    else:
        quantiles = F.percentile_approx(F.col(value), FRACTIONS, accuracy)
    return [F.count(value).alias("_n"), quantiles.alias("_q")]


def _fences(mode: str) -> tuple[Column, Column]:
    q = F.col("_q")
    iqr = q[1] - q[0]
    fences = {
        "iqr": (F.greatest(F.lit(0.0), q[0] - IQR_FACTOR * iqr), q[1] + IQR_FACTOR * iqr),
        "quantile": (q[2], q[3]),
    }
    if mode == "auto":
        many = F.col("_n") > IQR_MIN_VALUES
        low, high = (F.when(many, fences["iqr"][i]).otherwise(fences["quantile"][i]) for i in (0, 1))
    else:
        low, high = fences[mode]
    known = q[0].isNotNull()
    return F.when(known, low), F.when(known, high)


def outlier_bounds(
    df: DataFrame,
    value: str = DEMAND,
    *,
    by: Sequence[str] = BY,
    mode: str = "auto",
    accuracy: int | None = None,
    selection: str = "buffer",
) -> DataFrame:
    """Lower and upper fence per series.

    ``mode="iqr"`` gives ``max(0, q25 - 3.5 IQR)`` and ``q75 + 3.5 IQR``;
    ``mode="quantile"`` the 0.1 % and 99.9 % quantiles; ``"auto"`` uses quantiles for
    series of up to ten values.

    Quantiles are exact (or sketched, with ``accuracy``). ``selection="buffer"`` holds the distinct values of a series in a task, of
    which a grid has one per step; ``"histogram"`` is for raw readings of any number and reads ``df`` several times.
    """
    low, high = _fences(mode)
    if selection not in ("buffer", "histogram"):
        raise ValueError(f"selection is buffer or histogram, not {selection!r}")
    if selection == "histogram":
        found = exact_quantiles(df, value, FRACTIONS, by=by)
        found = found.select(*by, F.col("n").alias("_n"), F.coalesce("quantiles", F.array(*[F.lit(None).cast("double")] * 4)).alias("_q"))
    else:
        found = df.groupBy(*by).agg(*_fence_inputs(value, accuracy))
    return (
        found.select(
            *by,
            F.col("_n").alias("n_values"),
            F.col("_q")[0].alias("q25"),
            F.col("_q")[1].alias("q75"),
            low.alias("lower"),
            high.alias("upper"),
        )
    )


def _clip(value: Column, low: Column, high: Column) -> Column:
    # greatest and least skip nulls, so a missing value must be kept out of them.
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def clip_outliers(
    df: DataFrame,
    value: str = DEMAND,
    *,
    by: Sequence[str] = BY,
    freq: str = "hour",
    time: str = TIME,
    mode: str = "auto",
    accuracy: int | None = None,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Clip ``value`` to the fences of its series; null stays null."""
    low, high = _fences(mode)
    fenced = attach(
        df,
        _fence_inputs(value, accuracy),
        [low.alias("_lower"), high.alias("_upper")],
        by=by,
        freq=freq,
        time=time,
        chunk_steps=chunk_steps,
    )
    clipped = _clip(F.col(value), F.col("_lower"), F.col("_upper"))
    return fenced.withColumn(value, clipped).drop("_lower", "_upper")


def _with_neighbours(
    df: DataFrame,
    columns: Sequence[str],
    *,
    by: Sequence[str],
    freq: str,
    time: str,
    chunk_steps: int,
    back: bool = True,
    ahead: bool = True,
) -> DataFrame:
    """Add step and value of the previous and next valid reading of each column.

    Inside a chunk both come from running windows (the next one in descending order,
    so no frame grows past the current row). Across chunks they come from a table
    with one row per chunk, aggregated from the same exchange of rows.
    """
    step, row = F.col(STEP_COL), F.col("_row")
    # Rows are dealt to chunks once. The borders are taken from the same exchange: whole rows go along, because
    # an exchange with other columns would be another one.
    base = with_chunk(df, freq=freq, time=time, chunk_steps=chunk_steps)
    whole = F.struct(*[c for c in df.columns if c not in by]).alias("_row")
    for key in (*by, CHUNK_COL):  # what the join below would ask of one branch only
        base = base.filter(F.col(key).isNotNull())
    base = base.select(*by, CHUNK_COL, STEP_COL, whole).repartition(*by, CHUNK_COL)
    ends, values = [], {}
    for c in columns:
        valid = F.when(row[c].isNotNull(), step)
        if back:
            ends += [F.max(valid).alias(f"_{c}_ls"), F.max_by("_row", valid).alias(f"_{c}_lr")]
            values[f"_{c}_lv"] = F.col(f"_{c}_lr")[c]
        if ahead:
            ends += [F.min(valid).alias(f"_{c}_fs"), F.min_by("_row", valid).alias(f"_{c}_fr")]
            values[f"_{c}_fv"] = F.col(f"_{c}_fr")[c]
    chunks = base.groupBy(*by, CHUNK_COL).agg(*ends).withColumns(values)
    order = Window.partitionBy(*by)  # one row per chunk
    earlier = order.orderBy(CHUNK_COL).rowsBetween(Window.unboundedPreceding, -1)
    later = order.orderBy(F.col(CHUNK_COL).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for c in columns:
        if back:
            carried += [
                F.last(f"_{c}_ls", True).over(earlier).alias(f"_{c}_ps"),
                F.last(f"_{c}_lv", True).over(earlier).alias(f"_{c}_pv"),
            ]
        if ahead:
            carried += [
                F.last(f"_{c}_fs", True).over(later).alias(f"_{c}_ns"),
                F.last(f"_{c}_fv", True).over(later).alias(f"_{c}_nv"),
            ]
    out = base.join(chunks.select(*by, CHUNK_COL, *carried), [*by, CHUNK_COL])
    borders = [f"_{c}_{k}" for c in columns for k in (["ps", "pv"] if back else []) + (["ns", "nv"] if ahead else [])]
    out = out.select(*by, CHUNK_COL, STEP_COL, "_row.*", *borders)
    up = chunk_window(by).rowsBetween(Window.unboundedPreceding, 0)
    down = chunk_window(by, descending=True).rowsBetween(Window.unboundedPreceding, 0)
    near = {}
    for c in columns:
        valid = F.when(F.col(c).isNotNull(), step)
        if back:
            near[f"_{c}_ps"] = F.coalesce(F.last(valid, True).over(up), F.col(f"_{c}_ps"))
            near[f"_{c}_pv"] = F.coalesce(F.last(c, True).over(up), F.col(f"_{c}_pv"))
        if ahead:
            near[f"_{c}_ns"] = F.coalesce(F.last(valid, True).over(down), F.col(f"_{c}_ns"))
            near[f"_{c}_nv"] = F.coalesce(F.last(c, True).over(down), F.col(f"_{c}_nv"))
    return out.withColumns(near)


def ffill(
    df: DataFrame,
    columns: Sequence[str] = (DEMAND,),
    limit: int | None = FFILL_LIMIT,
    *,
    by: Sequence[str] = BY,
    freq: str = "hour",
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Forward fill, at most ``limit`` steps from the last reading."""
    near = _with_neighbours(df, columns, by=by, freq=freq, time=time, chunk_steps=chunk_steps, ahead=False)
    filled = {}
    for c in columns:
        previous = F.col(f"_{c}_pv")
        if limit is not None:
            previous = F.when(F.col(STEP_COL) - F.col(f"_{c}_ps") <= limit, previous)
        filled[c] = F.coalesce(F.col(c), previous)
    return near.withColumns(filled).select(*df.columns)


def interpolate_linear(
    df: DataFrame,
    columns: Sequence[str] = (DEMAND,),
    *,
    by: Sequence[str] = BY,
    freq: str = "hour",
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Straight line between readings; the last reading is held, a leading gap stays."""
    near = _with_neighbours(df, columns, by=by, freq=freq, time=time, chunk_steps=chunk_steps)
    filled = {}
    for c in columns:
        ps, pv, ns, nv = (F.col(f"_{c}_{k}") for k in ("ps", "pv", "ns", "nv"))
        line = pv + (nv - pv) * (F.col(STEP_COL) - ps) / (ns - ps)
        filled[c] = F.coalesce(F.col(c), F.when(ns.isNull(), pv).otherwise(line))
    return near.withColumns(filled).select(*df.columns)


def bfill(
    df: DataFrame,
    columns: Sequence[str] = (DEMAND,),
    *,
    by: Sequence[str] = BY,
    freq: str = "hour",
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Fill every gap with the next reading."""
    near = _with_neighbours(df, columns, by=by, freq=freq, time=time, chunk_steps=chunk_steps, back=False)
    return near.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}_nv")) for c in columns}).select(*df.columns)


def _chain(v: Column, i: Column, ps: Column, pv: Column, ns: Column, nv: Column, limit: int) -> Column:
    """Forward fill up to ``limit`` steps, then a straight line, then backward fill.

    Beyond ``limit`` the line starts at the last forward-filled step and ends at the
    next reading; ``p`` and ``n`` are step and value of the readings around step ``i``.
    """
    anchor = ps + limit
    return (
        F.when(v.isNotNull(), v)
        .when(pv.isNull(), nv)
        .when((i <= anchor) | nv.isNull(), pv)
        .otherwise(pv + (nv - pv) * (i - anchor) / (ns - anchor))
    )


def fill_gaps(
    df: DataFrame,
    columns: Sequence[str] = (DEMAND, TEMP, HUMIDITY),
    limit: int = FFILL_LIMIT,
    *,
    by: Sequence[str] = BY,
    freq: str = "hour",
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Forward fill up to ``limit`` steps, then a straight line, then backward fill."""
    near = _with_neighbours(df, columns, by=by, freq=freq, time=time, chunk_steps=chunk_steps)
    filled = {
        c: _chain(F.col(c), F.col(STEP_COL), *(F.col(f"_{c}_{k}") for k in ("ps", "pv", "ns", "nv")), limit)
        for c in columns
    }
    return near.withColumns(filled).select(*df.columns)


def fill_residual(
    df: DataFrame,
    columns: Sequence[str],
    *,
    by: Sequence[str] = BY,
    freq: str = "hour",
    time: str = TIME,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Whatever is still missing takes the next reading, else the previous one."""
    near = _with_neighbours(df, columns, by=by, freq=freq, time=time, chunk_steps=chunk_steps)
    return near.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_{c}_nv"), F.col(f"_{c}_pv")) for c in columns}
    ).select(*df.columns)


def clean(
    df: DataFrame,
    *,
    by: Sequence[str] = BY,
    freq: str = "hour",
    time: str = TIME,
    clip_mode: str = "auto",
    ffill_limit: int = FFILL_LIMIT,
    accuracy: int | None = None,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Resample to the grid, clip demand, fill gaps in demand and weather.

    Equal to ``resample_mean``, ``clip_outliers`` and ``fill_gaps`` one after the other,
    but planned as one pass: readings are aggregated once, neighbours are looked up
    between filled steps only, and the empty steps are generated already filled.
    Other numeric columns are averaged and filled as residuals; columns of other types
    are dropped, since they have no mean.
    """
    check_time_column(df, time)
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in by and f.name != time
    ]
    main = [c for c in (DEMAND, TEMP, HUMIDITY) if c in numeric]
    step = F.col(STEP_COL)
    filled = (
        keyed(df, by, time)
        .groupBy(*by, step_of(F.col(time), freq).alias(STEP_COL))
        .agg(*[F.avg(not_nan(c)).alias(c) for c in numeric])
    )
    rows = filled.withColumn(CHUNK_COL, chunk_of(step, chunk_steps))
    markers = _chunk_markers(rows, numeric, by, chunk_steps)
    if DEMAND in main:
        low, high = _fences(clip_mode)
        bounds = filled.groupBy(*by).agg(*_fence_inputs(DEMAND, accuracy))
        markers = markers.join(bounds.select(*by, low.alias("_lower"), high.alias("_upper")), list(by))
    rows = rows.unionByName(markers, allowMissingColumns=True)

    # The marker opens its chunk: whatever it carries is the first value of the window.
    up = Window.partitionBy(*by, CHUNK_COL).orderBy(step, F.col("_until").isNull())
    down = Window.partitionBy(*by, CHUNK_COL).orderBy(step.desc(), F.col("_until").isNull().desc())
    opening = up.rowsBetween(Window.unboundedPreceding, 0)
    after = down.rowsBetween(Window.unboundedPreceding, -1)

    def from_marker(name: str) -> Column:
        return F.first(name, True).over(opening)

    near = {"_last": F.coalesce(F.lead(step).over(up) - 1, from_marker("_until"))}
    for c in numeric:
        valid = F.when(F.col(c).isNotNull(), step)
        near[f"_{c}_ps"] = F.coalesce(F.last(valid, True).over(opening), from_marker(f"_{c}_ps"))
        near[f"_{c}_pv"] = F.coalesce(F.last(c, True).over(opening), from_marker(f"_{c}_pv"))
        near[f"_{c}_ns"] = F.coalesce(F.last(valid, True).over(after), from_marker(f"_{c}_ns"))
        near[f"_{c}_nv"] = F.coalesce(F.last(c, True).over(after), from_marker(f"_{c}_nv"))
    if DEMAND in main:
        near |= {k: from_marker(k) for k in ("_lower", "_upper")}
    covered = rows.withColumns(near).filter(F.col("_last") >= step)
    dense = covered.withColumn("_at", F.explode(F.sequence(STEP_COL, "_last")))

    at = F.col("_at")
    out = []
    for c in numeric:
        v = F.when(at == step, F.col(c))
        ps, pv, ns, nv = (F.col(f"_{c}_{k}") for k in ("ps", "pv", "ns", "nv"))
        if c == DEMAND:
            v, pv, nv = (_clip(x, F.col("_lower"), F.col("_upper")) for x in (v, pv, nv))
        value = _chain(v, at, ps, pv, ns, nv, ffill_limit) if c in main else F.coalesce(v, nv, pv)
        out.append(value.alias(c))
    return dense.select(*by, time_of(at, freq).alias(time), *out)


def _chunk_markers(rows: DataFrame, columns: Sequence[str], by: Sequence[str], chunk_steps: int) -> DataFrame:
    """One row per chunk a series spans: where it starts and ends, and the last reading
    before and first reading after it, per column."""
    step = F.col(STEP_COL)
    ends = [F.min(step).alias("_lo"), F.max(step).alias("_hi")]
    for c in columns:
        valid = F.when(F.col(c).isNotNull(), step)
        ends += [
            F.max(valid).alias(f"_{c}_ls"),
            F.max_by(c, valid).alias(f"_{c}_lv"),
            F.min(valid).alias(f"_{c}_fs"),
            F.min_by(c, valid).alias(f"_{c}_fv"),
        ]
    chunks = rows.groupBy(*by, CHUNK_COL).agg(*ends)
    series = Window.partitionBy(*by)  # one row per chunk
    up = series.orderBy(CHUNK_COL)
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    later = series.orderBy(F.col(CHUNK_COL).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        "_series_hi": F.max("_hi").over(series),
        "_next_chunk": F.coalesce(F.lead(CHUNK_COL).over(up), F.col(CHUNK_COL) + 1),
        "_first": F.row_number().over(up) == 1,
    }
    for c in columns:
        for k, end, frame in (("p", "l", earlier), ("n", "f", later)):
            for part in ("s", "v"):
                carried[f"_{c}_{k}{part}"] = F.last(f"_{c}_{end}{part}", True).over(frame)
    # A chunk without any reading gets its marker from the last chunk that has one.
    chunk = F.col("_at_chunk")
    spread = chunks.withColumns(carried).withColumn(
        "_at_chunk", F.explode(F.sequence(F.col(CHUNK_COL), F.col("_next_chunk") - 1))
    )
    own = chunk == F.col(CHUNK_COL)
    neighbours = []
    for c in columns:
        for part in ("s", "v"):
            before = F.coalesce(F.col(f"_{c}_l{part}"), F.col(f"_{c}_p{part}"))
            neighbours += [
                F.when(own, F.col(f"_{c}_p{part}")).otherwise(before).alias(f"_{c}_p{part}"),
                F.col(f"_{c}_n{part}"),
            ]
    return spread.select(
        *by,
        chunk.alias(CHUNK_COL),
        F.when(own & F.col("_first"), F.col("_lo")).otherwise(chunk * chunk_steps).alias(STEP_COL),
        F.least(F.col("_series_hi"), (chunk + 1) * chunk_steps - 1).alias("_until"),
        *neighbours,
    )
