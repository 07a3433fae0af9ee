"""Whitening of embeddings, with components found by spectral divide and conquer.

The covariance is summed by Spark. Its components come from polar decompositions: the orthogonal
polar factor of the covariance less a shift has eigenvalue 1 above the shift and -1 below, so it gives
the projectors of two invariant subspaces. Each is split again until it has one dimension. Polar
factors are found by dynamically weighted Halley steps on QR factors. The driver holds
matrices of dimension squared, never rows; the whitening matrix goes along with the tasks.

Vectors that are null or have null or non-finite entries are left out, and so are those whose length
differs from most (the longer of two lengths that are equally frequent), for which no projection is
defined. Entries count as integers, ``floor(64 * c) + 1000000``. Repeated or null ids are rows like any other.
Components without variance (below 1e-11 of all) can't be scaled to one and are left out; so a table
of equal vectors, or of none, gives no rows. Extra columns are ignored.
Integers beyond 64 bits raise ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.store import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Share of all variance below which a component counts as having none.
NO_VARIANCE = 1e-11
_LARGEST = 2.0**62
_ROWS = 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without an eigenvalue of zero."""
    size = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    try:
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))  # no larger than the smallest singular value
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, 1e-17), 1.0)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4.0 * (1.0 - square) / square**2)
        root = np.sqrt(1.0 + d)
        p = root + 0.5 * np.sqrt(max(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * root), 0.0))
        q = (p - 1.0) ** 2 / 4.0
        r = p + q - 1.0
        factors, _ = np.linalg.qr(np.vstack((np.sqrt(r) * x, np.eye(size))))
        new = q / r * x + (p - q / r) / np.sqrt(r) * (factors[:size] @ factors[size:].T)
        new = (new + new.T) / 2.0
        low = min(low * (p + q * square) / (1.0 + r * square), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-5 and 1.0 - low < 1e-14:
            break
    return x


def _split(a: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces above and below a shift near the mean eigenvalue; None if all are equal."""
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size)) / np.sqrt(size)
    if spread <= 4.0 * np.finfo(float).eps * whole:
        return None
    start = np.random.default_rng(1).standard_normal((size, size))
    best = None
    for step in (0.0, 0.15, -0.15, 0.3, -0.3, 0.45, -0.45):
        projector = (np.eye(size) + polar(a - (mean + step * spread) * np.eye(size))) / 2.0
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        basis, _ = np.linalg.qr(projector @ start)
        basis, _ = np.linalg.qr(projector @ basis[:, :rank], mode="complete")
        upper, lower = basis[:, :rank], basis[:, rank:]
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = (left, upper, lower)
        if left <= 8.0 * size * np.finfo(float).eps * whole:
            break
    return None if best is None else best[1:]


def leading_components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    whole = float(np.linalg.norm(v))
    found: list[np.ndarray] = []
    waiting = [np.eye(len(v))]
    while waiting and len(found) < count:
        basis = waiting.pop()
        a = basis.T @ v @ basis
        parts = _split((a + a.T) / 2.0, whole) if basis.shape[1] > 1 else None
        if parts is None:
            found += list(basis.T)
        else:
            waiting += [basis @ parts[1], basis @ parts[0]]  # the upper one is next
    vectors = np.array(found).T / np.linalg.norm(np.array(found), axis=1)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """Sizes, sums and scaled components of a fit list."""

    n: int
    sums: tuple[int, ...]
    matrix: np.ndarray
    explained: np.ndarray
    error: float = 0.0


def _integers(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the usable vectors and their entries as integers, one matrix per length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1), dtype=np.int64)
    flat = column.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")))
    ends = np.cumsum(np.maximum(sizes, 0))
    for size in np.unique(sizes) if length is None else [length]:
        places = np.flatnonzero(sizes == size)
        if size <= 0 or not len(places):
            continue
        rows = values[(ends[places] - size)[:, None] + np.arange(size)]
        fine = np.isfinite(rows).all(axis=1)
        x = np.floor(SCALE * rows[fine])
        if x.size and np.abs(x).max() >= _LARGEST:
            raise OverflowError("an entry is beyond 64-bit integers")
        yield places[fine], x.astype(np.int64) + SHIFT


def _tables(batches: Iterator[pa.RecordBatch], length: int | None, sums: tuple[int, ...], n: int):
    """Ids and centred vectors of one length, some thousand rows at a time."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            for places, x in _integers(part.column(part.num_columns - 1), length):
                yield part, places, x, (x - whole) - rest


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _integers(batch.column(0)):
            size = x.shape[1]
            counts[size] = counts.get(size, 0) + len(x)
            part = x.sum(axis=0) if not x.size or np.abs(x).max() < _LARGEST / max(len(x), 1) else None
            if part is None:
                raise OverflowError("the sum of entries is beyond 64-bit integers")
            totals[size] = totals.get(size, 0) + part
    for size, total in totals.items():
        yield pa.record_batch(
            {"size": pa.array([size] * size, pa.int32()), "place": pa.array(range(size), pa.int32()),
             "n": pa.array([counts[size]] * size, pa.int64()), "total": pa.array(total, pa.int64())}
        )


def _products(vectors: DataFrame, sums: tuple[int, ...], n: int, matrix: np.ndarray | None) -> np.ndarray:
    """Mean outer product of the centred, and maybe whitened, vectors, added up by Spark."""

    def products(batches):
        total = 0.0
        for _, _, _, centred in _tables(batches, len(sums), sums, n):
            rows = centred if matrix is None else centred @ matrix
            total = total + rows.T @ rows
        if isinstance(total, np.ndarray):
            size = len(total)
            yield pa.record_batch(
                {"i": pa.array(np.repeat(np.arange(size), size), pa.int32()), "j": pa.array(np.tile(np.arange(size), size), pa.int32()),
                 "v": pa.array(total.ravel(), pa.float64())}
            )

    cells = vectors.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    size = len(sums) if matrix is None else matrix.shape[1]
    out = np.zeros((size, size))
    for row in cells.collect():  # dimension squared cells
        out[row["i"], row["j"]] = row["v"] / n
    return out


def fit(fit_list: DataFrame, *, components: int = COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """Components of the vectors of ``fit_list``; None where there is no variance."""
    vectors = fit_list.select(vector)
    partial = vectors.mapInArrow(_sums, "size int, place int, n long, total long")
    totals = stored(partial.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    most = totals.where("place = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    n = most["n"]
    sums = tuple(r["total"] for r in totals.where(F.col("size") == most["size"]).orderBy("place").collect())
    v = _products(vectors, sums, n, None)
    trace = float(np.trace(v))
    if trace <= 0.0:
        return None
    values, parts = leading_components(v, min(components, len(sums)))
    real = values > NO_VARIANCE * trace
    matrix = parts[:, real] / np.sqrt(values[real])
    error = float(np.abs(_products(vectors, sums, n, matrix) - np.eye(matrix.shape[1])).max())
    return Whitening(n, sums, matrix, values[real] / trace, error)


def _deviations(x: np.ndarray, sums: tuple[int, ...], n: int) -> np.ndarray:
    """Exact sums of ``(n * x - S) ** 2`` per row."""
    means = [s // n for s in sums]
    far = float(np.abs(x - np.array(means, np.int64)).max(initial=0) + 1) * n
    if far * far * len(sums) < _LARGEST:
        # n * x - S without the large common part: n * (x - S // n) - S % n
        gaps = n * (x - np.array(means, np.int64)) - np.array([s % n for s in sums], np.int64)
        return (gaps * gaps).sum(axis=1)
    gaps = n * x.astype(object) - np.array(sums, object)
    total = (gaps * gaps).sum(axis=1)
    if len(total) and max(total) >= 2**63:
        raise OverflowError("a squared deviation is beyond 64-bit integers")
    return total.astype(np.int64)


def apply(vectors: DataFrame, fitted: Whitening | None, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component, from 1 for the largest variance."""
    rows = vectors.select(F.col(id).cast("long"), vector)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], SCHEMA.replace("vec_id", id))
    n, sums, matrix = fitted.n, fitted.sums, fitted.matrix
    explained, error = fitted.explained, fitted.error

    def whiten(batches):
        count = matrix.shape[1]
        for part, places, x, centred in _tables(batches, len(sums), sums, n):
            ids = part.column(0).take(pa.array(np.repeat(places, count)))
            size = len(places) * count
            yield pa.record_batch(
                {
                    id: ids,
                    "component": pa.array(np.tile(np.arange(1, count + 1), len(places)), pa.int32()),
                    "n": pa.array(np.full(size, n), pa.int64()),
                    "deviation": pa.array(np.repeat(_deviations(x, sums, n), count), pa.int64()),
                    "whitened": pa.array((centred @ matrix).ravel(), pa.float64()),
                    "explained": pa.array(np.tile(explained, len(places)), pa.float64()),
                    "identity_error": pa.array(np.full(size, error), pa.float64()),
                }
            )

    return rows.mapInArrow(whiten, SCHEMA.replace("vec_id", id))


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Fit on all usable vectors and whiten them."""
    return apply(vectors, fit(vectors, components=components, vector=vector), id=id, vector=vector)
