"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

The terms of a text are its distinct words and pairs of neighbouring words. A term weighs one
plus the binary logarithm of its count, in sixteenths, and its hash votes with that weight for
or against each of 64 bits. Sums are whole numbers, so equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm import text as T
from wattline.llm.store import shuffle_partitions

BITS = 64
RADIUS = 3
_SLICE = 1 << 18
_TERMS = 1 << 14
_LAST = -(1 << 63)
_END = (1 << 48) - 1
#: Blocks of bits of the near counts, and the fingerprints of one block value that are compared at once.
BLOCKS = 5
PART = 1024
_SALTS = 16


def _votes(own: np.ndarray) -> np.ndarray:
    """Votes of one text for each bit, given the hashes of its words; terms a block at a time."""
    pairs = T.mix(own[:-1] * np.uint64(3) + own[1:])
    terms, counts = np.unique(np.concatenate((own, pairs)), return_counts=True)
    weights = np.rint(16 * (1 + np.log2(counts))).astype(np.int32)
    votes = np.full(BITS, -weights.sum(), np.int64)
    for at in range(0, len(terms), _TERMS):
        bits = np.unpackbits(terms[at : at + _TERMS].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        votes += 2 * np.einsum("i,ij->j", weights[at : at + _TERMS], bits)  # summed in place, without a table of weighted bits
    return votes


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of each text; a text without words has 0."""
    out = np.zeros(len(texts), np.uint64)
    for low, high in T.slices(texts, _SLICE):
        found = T.words(texts.slice(low, high - low))
        votes = np.zeros((high - low, BITS), np.int64)
        for i in np.flatnonzero(found.counts).tolist():
            votes[i] = _votes(found.hashes[found.first[i] : found.first[i + 1]])
        out[low:high] = np.packbits(votes > 0, axis=1).view(">u8").ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` (16 hexadecimal digits); null counts as empty."""

    def add(batches):
        for batch in batches:
            prints = fingerprints(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{x:016x}" for x in prints.tolist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(add, "doc_id long, fingerprint string")


@dataclass
class Ranges:
    """Ranges of rows in order of (id descending, text), numbered from the last; a border is the first row of its range.

    ``keys`` are the ids of the borders, ascending. An id that fills more than one range is cut by the beginning of its texts
    as well: ``cuts`` has the beginnings of its borders, counted down from ``_END``, ascending.
    """

    keys: np.ndarray
    cuts: dict[int, np.ndarray]

    def __post_init__(self):
        sizes = [len(self.cuts.get(k, (0,))) for k in self.keys.tolist()]
        self.start = np.concatenate(([0], np.cumsum(sizes)))

    def __len__(self) -> int:
        return int(self.start[-1])

    def of(self, keys: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's range, and whether it may be the first of it."""
        at = np.searchsorted(self.keys, keys)
        part, first = self.start[at], self.keys[at] == keys
        for key, cuts in self.cuts.items():
            rows = np.flatnonzero(keys == key)
            down = _END - begins[rows]
            spot = np.searchsorted(cuts, down)
            part[rows] += spot
            first[rows] = cuts[spot] == down
        return part, first


def _ranges(keyed: DataFrame, parts: int) -> Ranges:
    """About ``parts`` ranges of rows alike in number."""
    top = F.max("key").alias("top")
    found = keyed.agg(top, F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("at")).first()
    if found.top is None:
        return Ranges(np.zeros(1, np.int64), {})
    guess, times = np.unique(np.minimum(np.array([*found.at, found.top], np.int64), found.top), return_counts=True)
    # Quantiles pass through floating point, which rounds large ids; a border is the largest id there is up to the quantile.
    tops = keyed.select("key").mapInArrow(_largest(guess), "place int, key long").groupBy("place").agg(F.max("key").alias("key"))
    exact = {r.place: r.key for r in tops.collect()}  # one row per range
    keys = np.array(sorted(exact.values()), np.int64)
    often = {k: int(times[i]) for i, k in exact.items() if times[i] > 1 and guess[i] == k}
    cuts = {}
    if often:  # each has more than a ``parts``-th of all rows
        begins = F.percentile_approx("begin", [i / parts for i in range(parts)], 10 * parts).alias("at")
        for r in keyed.where(F.col("key").isin(list(often))).groupBy("key").agg(begins, F.min("begin").alias("least")).collect():
            some = np.array(r.at, np.int64)[:: max(1, parts // often[r.key])]
            cuts[r.key] = np.unique(_END - np.append(some, r.least))
    return Ranges(keys, cuts)


def _largest(borders: np.ndarray):
    def largest(batches):
        out = np.full(len(borders), _LAST)
        seen = np.zeros(len(borders), bool)
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            place = np.searchsorted(borders, keys)
            np.maximum.at(out, place, keys)
            seen[place] = True
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], ["place", "key"])

    return largest


def _dealt(ranges: Ranges):
    """Each row with its range; the first row of a range, as far as a task can tell, is also sent to the one before."""

    def deal(batches):
        firsts: dict[int, tuple[str, pa.RecordBatch]] = {}
        for batch in batches:
            part, first = ranges.of(np.asarray(batch.column("key")), np.asarray(batch.column("begin")))
            rows = batch.select(["key", "doc_id", "text"])
            yield _to(rows, part, 0)
            for i in np.flatnonzero(first).tolist():
                text, own = rows.column("text")[i].as_py() or "", int(part[i])
                if own not in firsts or text < firsts[own][0]:
                    firsts[own] = text, rows.take(pa.array([i]))
        for own, (_, row) in firsts.items():
            yield _to(row, np.array([(own + 1) % len(ranges)]), 1)

    return deal


def _to(rows: pa.RecordBatch, part: np.ndarray, halo: int) -> pa.RecordBatch:
    marks = [pa.array(part.astype(np.int32)), pa.array(np.full(rows.num_rows, halo, np.int32))]
    return pa.RecordBatch.from_arrays([*rows.columns, *marks], [*rows.schema.names, "part", "halo"])


def _neighbours(batches) -> Iterator[tuple[int | None, str, str]]:
    """Rows with the text that follows each in its range."""
    held = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "halo", "doc_id", "text"))
        for part, halo, doc_id, text in zip(*columns, strict=True):
            text = text or ""
            if held and held[0] == part:
                yield held[1], held[2], text
            held = None if halo else (part, doc_id, text)


def _edited(batches):
    rows: list[tuple[int | None, str, str]] = []
    size = 0

    def finish():
        texts = [r[1] for r in rows]
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + after[:h] for (_, t, after), h in zip(rows, halves, strict=True)]
        own, new = fingerprints(pa.array(texts, pa.large_string())), fingerprints(pa.array(edited, pa.large_string()))
        ends = [i for i, r in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] is not r[2]]
        after = np.append(own[1:], np.uint64(0))
        after[ends] = fingerprints(pa.array([rows[i][2] for i in ends], pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([f"{x:016x}" for x in own.tolist()], pa.string()),
                pa.array([f"{x:016x}" for x in new.tolist()], pa.string()),
                pa.array(likeness(own, new), pa.float64()),
                pa.array(likeness(own, after), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for row in _neighbours(batches):
        rows.append(row)
        size += len(row[1]) + len(row[2])
        if size > 4 * _SLICE:
            yield from finish()
            rows, size = [], 0
    if rows:
        yield from finish()


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last half (rounded down, in code points) replaced by as much of
    the beginning of the next document's text, by descending id; after the last comes the
    first. Rows with equal ids follow each other by text; rows without an id come last. Null is
    the empty text. A table of one row follows itself.

    Rows are dealt to ranges of ids once, with the first row of each range copied to
    the range before it. Rows of one id (or without an id) that fill more than one range are cut by the first
    six bytes of their texts; those that agree in these as well stay together.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    begin = F.conv(F.rpad(F.hex(F.substring(F.coalesce(text, F.lit("")).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), begin.alias("begin"))
    ranges = _ranges(keyed.select("key", "begin"), shuffle_partitions(spark))
    dealt = keyed.mapInArrow(_dealt(ranges), "key long, doc_id long, text string, part int, halo int")
    ordered = dealt.repartitionById(len(ranges), "part").sortWithinPartitions("part", "halo", F.desc("key"), "text")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("part", "halo", "doc_id", "text").mapInArrow(_edited, kinds)


def within_radius(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Pairs ``a, b, distance`` of different fingerprints at most ``radius`` bits apart, ``a < b``.

    The bits are cut into ``blocks`` blocks (default: twice the radius). Two fingerprints within the radius agree
    on all blocks but ``radius``; there is one table for each choice of the others, keyed by
    their bits. Equal fingerprints count once; membership is the column itself.
    """
    blocks = blocks or max(2 * radius, radius + 1)
    borders = [i * BITS // blocks for i in range(blocks + 1)]
    masks = []
    for own in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << borders[i + 1]) - (1 << borders[i])) for i in own)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    value = F.when(F.col("fingerprint") >= "8", F.conv(F.col("fingerprint"), 16, -10)).otherwise(F.conv(F.col("fingerprint"), 16, 10)).cast("long")
    once = prints.where("fingerprint is not null").select("fingerprint").distinct().withColumn("bits", value)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("bits").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    keyed = once.withColumn("e", F.explode(tables)).select("fingerprint", "bits", "e.t", "e.key")
    a, b = keyed.alias("a"), keyed.alias("b")
    distance = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits")))
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fingerprint") < F.col("b.fingerprint")) & (distance <= radius))
    return met.select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"), distance.alias("distance")).distinct()


class _Tables:
    """The block tables: bits that name a row's place in each, and the first table where a pair meets."""

    def __init__(self, radius: int, blocks: int) -> None:
        borders = [i * BITS // blocks for i in range(blocks + 1)]
        self.parts = [np.uint64(sum(1 << b for b in range(low, high))) for low, high in zip(borders[:-1], borders[1:], strict=True)]
        own = [set(c) for c in combinations(range(blocks), blocks - radius)]
        self.masks = np.array([np.bitwise_or.reduce([self.parts[i] for i in sorted(o)]) for o in own], np.uint64)
        self.radius = radius
        # By the blocks in which two fingerprints differ; beyond the radius they may meet nowhere.
        differing = [{i for i in range(blocks) if d >> i & 1} for d in range(1 << blocks)]
        self.first = np.array([next((t for t, o in enumerate(own) if not o & d), -1) for d in differing])

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """One key per fingerprint and table; its last eight bits are the table."""
        mixed = T.mix(bits[:, None] & self.masks)
        return (mixed & ~np.uint64(255)) | np.arange(len(self.masks), dtype=np.uint64)

    def links(self, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
        """Which pairs are different, within the radius, and meet in this table first."""
        apart = a[:, None] ^ b[None, :]
        out = (np.bitwise_count(apart) <= self.radius) & (apart != 0)
        i, j = np.nonzero(out)
        where = np.zeros(len(i), np.int64)
        for k, part in enumerate(self.parts):
            where |= ((apart[i, j] & part) != 0).astype(np.int64) << k
        out[i, j] = self.first[where] == table
        return out


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``bits, n_near``: for each different fingerprint (as a 64-bit number) that has any, how many others are within ``radius``.

    Two fingerprints within the radius agree on all blocks but ``radius``, so they meet in a table; a pair counts
    in the first of them. Fingerprints of a block value are compared ``PART`` by ``PART``; those of a frequent value are dealt to pairs of parts
    first, so that no task gets all of them. Pairs are counted, never listed.
    """
    tables = _Tables(radius, blocks)

    def deal(batches):
        for batch in batches:
            bits = np.asarray(batch.column(0)).view(np.uint64)
            keys = tables.keys(bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(bits, len(tables.masks)).view(np.int64))], ["key", "bits"])

    def counted(found: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["bits", "n_near"])

    def compare(batches):
        found: dict[int, int] = {}
        for group in T.runs(batches, ["key", "p", "q"]):
            table = group.column("key")[0].as_py() & 255
            p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
            bits, part = np.asarray(group.column("bits")), np.asarray(group.column("part"))
            a, b = (bits[part == x] for x in (p, q))
            links = tables.links(a.view(np.uint64), b.view(np.uint64), table)
            for side, own in ((a, links.sum(axis=1)), (b, links.sum(axis=0)))[: 1 if p == q else 2]:
                for i in np.flatnonzero(own).tolist():
                    found[int(side[i])] = found.get(int(side[i]), 0) + int(own[i])
            if len(found) > 100_000:
                yield counted(found)
                found = {}
        yield counted(found)

    value = F.when(F.col("fingerprint") >= "8", F.conv(F.col("fingerprint"), 16, -10)).otherwise(F.conv(F.col("fingerprint"), 16, 10)).cast("long")
    once = prints.where("fingerprint is not null").select(value.alias("bits")).distinct()
    keyed = once.mapInArrow(deal, "key long, bits long").repartition(shuffle_partitions(prints.sparkSession), "key")
    sized = keyed.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    zero = F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("part")
    few = sized.where(F.col("size") <= PART).select("key", *zero, "bits")
    parts = F.ceil(F.col("size") / PART).cast("int")
    many = sized.where(F.col("size") > PART).withColumns({"part": F.pmod(F.xxhash64("bits"), parts).cast("int"), "parts": parts})
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "bits")
    many = many.repartition(shuffle_partitions(prints.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q")
    kinds = "bits long, n_near long"
    counts = few.mapInArrow(compare, kinds).unionByName(many.mapInArrow(compare, kinds))
    return counts.groupBy("bits").agg(F.sum("n_near").alias("n_near"))


def with_near(rows: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` with ``n_near``: how many different fingerprints of ``prints`` are within ``radius`` of a row's own.

    Rows of one fingerprint, which copies have, are dealt to several join keys.
    """
    near = near_counts(prints, radius).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    near = near.select(F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "salt", "n_near")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS)).cast("int"))
    joined = salted.join(near, ["fingerprint", "salt"], "left")
    return joined.select(*rows.columns, F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
