"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (signs and a fast Hadamard transform, three times) turns a unit vector; its bucket is the
nearest signed axis. Each table has its own rotation. A query looks into its own bucket of every
table and into those of the next nearest axes, and everything found there is reranked by exact cosine.

Equal vectors are indexed once with their smallest ids, a crowded bucket is cut into chunks,
and each chunk returns the best few of each query, so neither pairs nor whole buckets travel.
A query that finds too few neighbours is compared with all vectors, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm import text as T
from wattline.llm.store import shuffle_partitions, stored

NEAREST = 5
TABLES = 16
PROBES = 4
CHUNK = 4096
EVERYTHING = -1


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """The pseudo-rotation of a table; vectors are filled up with zeros to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for turn in range(3):
        signs = 1 - 2 * (T.seeds(size, 1000 * table + turn + 50) >> np.uint64(63)).astype(float)
        y *= signs
        half = 1
        while half < size:
            z = y.reshape(len(y), -1, 2, half)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), size)
            half *= 2
        y /= np.sqrt(size)
    return y


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each vector, nearest first."""
    turned = rotate(x, table)
    both = np.concatenate((turned, -turned), axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: rows with an id and a vector of finite numbers that isn't zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return rows.where(f"{finite} and exists(v, x -> x <> 0)")


def _packed(kind: str):
    """Vectors as bytes of their own type: half the size for single precision, and no list to walk through."""

    def pack(batches):
        for batch in batches:
            flat = np.asarray(pc.list_flatten(batch.column("v")), kind)
            vectors = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("ids"), pa.array([v.tobytes() for v in vectors], pa.binary())], ["ids", "v"])

    return pack


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors as rows. Each is brought to numbers of at most one by a power of two: no cosine changes, no square overflows or vanishes."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, 1))
    x = np.frombuffer(b"".join(rows), kind).astype(np.float64).reshape(len(rows), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _keyed(tables: int, probes: int, kind: str):
    """One row per table and axis of each vector."""

    def key(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                x = _matrix(part.column("v"), kind)
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                for table in range(tables):
                    near = axes(x, table, probes)
                    rows = np.repeat(np.arange(len(x)), near.shape[1])
                    bucket = pa.array((near + 2 * (1 << 20) * table).ravel().astype(np.int64))
                    yield pa.RecordBatch.from_arrays([bucket, *part.take(pa.array(rows)).columns], ["bucket", "ids", "v"])

    return key


def _best(count: int, kind: str):
    def best(batches):
        for group in T.runs(batches, ["bucket", "chunk", "turn"]):
            asks = np.asarray(group.column("ask"))
            index, asking = group.filter(pa.array(asks == 0)), group.filter(pa.array(asks == 1))
            if not index.num_rows or not asking.num_rows:
                continue
            own = [np.array(x, np.int64) for x in index.column("ids").to_pylist()]
            x, y = _matrix(index.column("v"), kind), _matrix(asking.column("v"), kind)
            sizes, queries = np.sqrt((x * x).sum(axis=1)), [q[0] for q in asking.column("ids").to_pylist()]
            out = []
            for low in range(0, len(y), 256):
                part = y[low : low + 256]
                rough = (part @ x.T) / sizes
                for i, close in enumerate(rough):
                    query, some = queries[low + i], count + 4
                    while True:
                        # All that tie with the last one looked at, within rounding, are looked at too.
                        some = min(some, len(x))
                        last = np.partition(close, len(x) - some)[len(x) - some]
                        places = np.flatnonzero(close >= last - 1e-5 * np.sqrt((part[i] * part[i]).sum()))
                        exact = (x[places] * part[i]).sum(axis=1) / (sizes[places] * np.sqrt((part[i] * part[i]).sum()))
                        best = {}
                        for score, p in zip(exact.tolist(), places, strict=True):
                            for c in own[p].tolist():
                                if c != query:
                                    best[c] = max(score, best.get(c, -np.inf))
                        # Repeated ids and the query's own may use up the places.
                        if len(best) >= count or some == len(x):
                            break
                        some *= 4
                    found = sorted((-score, c) for c, score in best.items())
                    out += [(query, c, -s) for s, c in found[:count]]
            if out:
                a, b, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return best


def _search(index: DataFrame, asking: DataFrame, count: int, kind: str) -> DataFrame:
    """Best of each query in each chunk of the buckets it asks; ``bucket, ids, v`` on either side.

    Chunks and turns bound the vectors and the queries of one group.
    """
    parts = index.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    turns = asking.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("turns"))
    sizes = parts.join(turns, "bucket")
    which = F.xxhash64(F.col("ids")[0])
    left = index.join(sizes, "bucket").select(
        "bucket", F.pmod(which, F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("ask"), "ids", "v"
    )
    right = asking.join(sizes, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(which, F.col("turns")).cast("int").alias("turn"), F.lit(1).alias("ask"), "ids", "v"
    )
    dealt = left.unionByName(right).repartition(shuffle_partitions(index.sparkSession), "bucket", "chunk", "turn").sortWithinPartitions("bucket", "chunk", "turn")
    return dealt.mapInArrow(_best(count, kind), "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, count: int = NEAREST, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per query its ``count`` nearest vectors found: ``query_id, rank, vec_id, score``.

    ``score`` is the cosine of the original vectors in double precision, ties go to the
    smaller id, a row with the query's own id is no candidate. Vectors that are null, zero, hold null or
    non-finite numbers or differ in length from most take no part; nor do rows without an id. A repeated id counts
    once, by its nearest vector. With fewer candidates than ``count``, all are returned.
    """
    usable = _usable(vectors, id_col, vector_col).select("id", "v")
    length = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    fits = F.size("v") == F.lit(length[0] if length else 0)
    # The smallest ids of each distinct vector: as many as any query can use.
    first = Window.partitionBy("v").orderBy("id")
    few = usable.where(fits).distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= count + 1)
    whole = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, packed = ("<f4" if whole else "<f8"), "ids array<long>, v binary"
    index = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids", "v")
    index = stored(index.mapInArrow(_packed(kind), packed))
    asking = _usable(queries, id_col, vector_col).where(fits).distinct().select(F.array("id").alias("ids"), "v")
    asking = stored(asking.mapInArrow(_packed(kind), packed))
    hashed = [rows.mapInArrow(_keyed(tables, n, kind), f"bucket long, {packed}") for rows, n in ((index, 1), (asking, probes))]
    found = stored(_search(*hashed, count, kind).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= count)
    short = stored(asking.withColumn("query_id", F.col("ids")[0]).join(enough, "query_id", "left_anti").select("ids", "v"))
    if not short.isEmpty():
        # Every vector in one "bucket", dealt to blocks by its chunks.
        blocks = index.select(F.lit(EVERYTHING).cast("long").alias("bucket"), "ids", "v")
        more = _search(blocks, short.select(F.lit(EVERYTHING).cast("long").alias("bucket"), "ids", "v"), count, kind)
        found = found.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")
