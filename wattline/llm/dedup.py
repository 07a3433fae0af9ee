"""Near-duplicate documents by circulant MinHash.

Every distinct run of five words is a number of 32 bits after the first permutation. The
second permutation, read at circularly shifted places, gives all signature coordinates.
Bands of the signature name buckets; texts that meet in a bucket, directly or through
others, form a block, and inside a block the full sets are compared.

Exact copies count once. A block of any size is cut into parts of bounded size, and
pairs of parts are compared each in a group of its own, which returns a spanning forest of
its links, so no pair list is ever emitted and no task holds an unbounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import text as T
from wattline.llm.graph import components
from wattline.llm.store import shuffle_partitions, stored

THRESHOLD = 80
ROWS = 6
MISS = 1e-8
PART_DOCS = 512
PART_SHINGLES = 500_000
_COLUMNS = 4096


def bands_for(threshold: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which a pair just at ``threshold`` per cent is overlooked with at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((threshold / 100) ** rows)))


def _shifted(x: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def band_keys(values: np.ndarray, borders: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key per text and band; every text has at least one value."""
    first = T.mix(values).astype(np.uint32)
    keys = np.zeros((len(borders) - 1, bands), np.uint64)
    places = T.seeds(rows, 3)
    for k in range(bands * rows):
        low = np.minimum.reduceat(_shifted(first + np.uint32(k)), borders[:-1])
        keys[:, k // rows] += low * places[k % rows]
    return T.mix(keys + np.arange(bands, dtype=np.uint64))


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for low, high in T.slices(texts):
        values, borders = T.distinct(*T.shingles(T.words(texts.slice(low, high - low))))
        yield low, values, borders


def sketches(docs: DataFrame, bands: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, n, k1, k2, keys`` (set size, two hashes that name the set, bucket keys)."""

    def sketch(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, values, borders in _sets(texts):
                n = np.diff(borders)
                some = np.flatnonzero(n)
                k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys = [None] * len(n)
                if len(some):
                    at = borders[some]
                    k1[some] = np.add.reduceat(T.mix(values), at)
                    k2[some] = np.add.reduceat(T.mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
                    full = np.append(at, len(values))
                    for i, row in zip(some, band_keys(values, full, bands), strict=True):
                        keys[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, len(n)), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(keys, pa.binary())],
                    ["id", "n", "k1", "k2", "keys"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(sketch, "id long, n long, k1 long, k2 long, keys binary")


def _buckets(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 2048):
            part = batch.slice(low, 2048)
            rows = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            if rows:
                ids = np.repeat(np.asarray(part.column(0)), [len(r) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(rows))], ["id", "bucket"])


def _blocks(sets: DataFrame) -> DataFrame:
    """``(node, component)``: sets that meet in a bucket, directly or through others."""
    buckets = sets.select("id", "keys").mapInArrow(_buckets, "id long, bucket long")
    buckets = buckets.repartition(shuffle_partitions(sets.sparkSession), "bucket")  # once, for the heads and for the members
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last")
    return components(buckets.join(heads.select("bucket", "head"), "bucket"), "id", "head")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by blocks of shared values."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    places = [np.searchsorted(shared, s) for s in (*a, *b)]
    hits = [p[(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == s)] if len(shared) else p[:0] for p, s in zip(places, (*a, *b), strict=True)]
    out = np.zeros((len(a), len(b)), np.float64)
    for low in range(0, len(shared), _COLUMNS):
        dense = np.zeros((len(hits), min(_COLUMNS, len(shared) - low)), np.float32)
        for i, h in enumerate(hits):
            dense[i, h[np.searchsorted(h, low) : np.searchsorted(h, low + _COLUMNS)] - low] = 1
        out += dense[: len(a)] @ dense[len(a) :].T
    return out


def _forest(left: list[int], right: list[int], links: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect the same rows as all of them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    a, b = [], []
    for i, j in zip(*np.nonzero(links), strict=True):
        x, y = root(left[i]), root(right[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            a.append(left[i])
            b.append(right[j])
    return a, b


def _compare(threshold: int):
    def compare(batches):
        for group in T.runs(batches, ["block", "p", "q"]):
            ids, parts = group.column("id").to_pylist(), np.asarray(group.column("part"))
            sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
            p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
            left = np.flatnonzero(parts == p)
            right = np.flatnonzero(parts == q)
            if not len(left) or not len(right) or len(ids) < 2:
                continue
            a, b = [sets[i] for i in left], [sets[i] for i in right]
            both = _overlaps(a, b)
            union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
            links = 100 * both >= threshold * union
            x, y = _forest([ids[i] for i in left], [ids[i] for i in right], np.triu(links, 1) if p == q else links)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return compare


def _grams(batches):
    rest = ("id", "block", "parts", "part")
    for batch in batches:
        for low, values, borders in _sets(batch.column("text")):
            part = batch.slice(low, len(borders) - 1)
            grams = [values[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(grams, pa.binary())], [*rest, "grams"])


def near_duplicates(
    docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two texts are linked if 100 x shared runs is at least ``threshold`` x all runs of both.
    ``component_id`` is the smallest id reachable over links, ``kept`` says that it is the
    row's own. A pair at the threshold is overlooked with probability ``miss`` (it meets in no
    bucket); whatever meets is compared on the full sets.

    Null and empty texts have no runs and link with nothing. Equal ids are one document, linked
    by any of its texts. A row without an id links with nothing, has no component and is kept.
    """
    bands = bands_for(threshold, miss=miss)
    table = stored(sketches(docs, bands, id_col, text_col))
    known = table.where("id is not null and n > 0")
    names = known.groupBy("k1", "k2", "n").agg(F.min("id").alias("head"), F.max("id").alias("last"))
    copies = known.join(names.where("head < last"), ["k1", "k2", "n"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
    sets = known.join(names.select("k1", "k2", "n", F.col("head").alias("id")), ["k1", "k2", "n", "id"], "left_semi")
    blocks = _blocks(sets)
    sized = sets.select("id", "n").join(blocks, F.col("id") == F.col("node")).select("id", "n", F.col("component").alias("block"))
    parts = sized.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / PART_DOCS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    members = stored(sized.select("id", "block").distinct().join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    grams = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .join(members, "id")
        .select("id", "block", "parts", "part", "text")
        .mapInArrow(_grams, "id long, block long, parts int, part int, grams binary")
    )
    spread = grams.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "block", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "id", "part", "grams"
    )
    links = (
        spread.repartition(shuffle_partitions(docs.sparkSession), "block", "p", "q")
        .sortWithinPartitions("block", "p", "q", "id")
        .mapInArrow(_compare(threshold), "a long, b long")
    )
    found = components(links.unionByName(copies))
    out = table.select("id", "n").join(found, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


_KEY = "_row_key"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a key: the id, or a number above all ids where an id is null or goes with different rows.

    Rows that agree in id and text share a key; all others have keys of their own.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    repeated = stored(ids.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1 or _id is null").select("_id"))
    plain = docs.withColumn(_KEY, F.col(id_col).cast("long"))
    if repeated.isEmpty():
        return plain
    top = ids.agg(F.max("_id")).first()[0]
    twice = repeated.select(F.coalesce("_id", F.lit(0)).alias("_i"), F.col("_id").isNull().alias("_none"))
    marked = plain.withColumns({"_i": F.coalesce(_KEY, F.lit(0)), "_none": F.col(_KEY).isNull()})
    special = marked.join(twice, ["_i", "_none"], "left_semi").withColumn("_digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    # Stored before it is numbered, so that the numbers stay.
    names = stored(special.select("_i", "_none", "_digest").distinct())
    number = F.monotonically_increasing_id() + F.lit(max(top if top is not None else 0, 0) + 1)
    names = stored(names.withColumn(_KEY, number))
    numbered = special.drop(_KEY).join(names, ["_i", "_none", "_digest"])
    rest = marked.join(twice, ["_i", "_none"], "left_anti")
    return rest.select(*docs.columns, _KEY).unionByName(numbered.select(*docs.columns, _KEY))


def drop_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates.

    Rows link by their texts alone. Of a group the row with the smallest id stays; rows whose id is null, or is the
    id of another row as well, come after those with an id of their own. Of rows that agree in id and text one stays (the least in
    all its columns). Null and empty texts link with nothing.
    """
    keyed = _keyed(docs, id_col, text_col)
    marked = near_duplicates(keyed, threshold, _KEY, text_col)
    flags = marked.groupBy(F.col("doc_id").alias(_KEY)).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows"))
    flags = stored(flags.where("not kept or rows > 1"))
    left = keyed.join(flags.where("not kept").select(_KEY), _KEY, "left_anti").select(*keyed.columns)
    twice = flags.where("kept").select(_KEY)
    if twice.isEmpty():
        return left.select(*docs.columns)
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    merged = left.join(twice, _KEY, "left_semi").groupBy(_KEY).agg(F.min(rows).alias("row")).select("row.*")
    return left.join(twice, _KEY, "left_anti").select(*docs.columns).unionByName(merged)
