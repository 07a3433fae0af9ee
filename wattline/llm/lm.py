"""Cross-entropy difference of documents under two bigram models.

The target model is counted on all documents labelled good, the background model on all documents.
Both share one vocabulary: every word that occurs in the target documents at least twice, any other word
being unknown, as the method is defined. A word's probability is its share after the word before it, mixed with
its share overall. A document's score is the mean over its words of target loss minus
background loss: below zero, the target model expects it better.

The vocabulary grows with the target documents; each task holds it, 8 bytes a word, and those that look
up pairs its counts, 40 bytes a word. Word pairs have 64 bits and travel compressed in arrays.
Texts are told good where they are read, by two bitmaps of hashed ids of fixed size: of the good ids, and of other rows' ids that the
first takes in. Only rows in both are moved and joined by id. Counts are summed in each task and then by bucket of pairs. Pairs
that make up a 20,000th of all or more are at most 20,000; their values go to every task. The
others are looked up where their bucket's counts are, so no pair can crowd a task, and
come back as one partial sum per document and bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import text as T
from wattline.llm.store import shuffle_partitions, stored

LEAST = 2
MIX = 0.7
FREQUENT = 20_000
_BLOCK_WORDS = 500_000
_HELD_WORDS = 250_000
_WORD = np.uint64(0xFFFFFFFF)
_BITS, _BITS_A_ROW = 1 << 26, 1 << 15
_TABLE, _ASK, _OWN = 0, 1, 2


@dataclass
class Words:
    """Word hashes in order; a word's number is its place plus one, 0 is unknown, the last starts a text."""

    known: np.ndarray

    @property
    def size(self) -> int:
        return len(self.known) + 2

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word with the one before it, packed in 64 bits, and the borders of the texts."""
        found = T.words(texts)
        number = np.zeros(len(found.hashes), np.uint64)
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, found.hashes), len(self.known) - 1)
            number = np.where(self.known[place] == found.hashes, place + 1, 0).astype(np.uint64)
        before = np.zeros_like(number)
        before[1:] = number[:-1]
        starts = found.first[:-1]
        before[starts[starts < found.first[1:]]] = self.size - 1
        return (before << np.uint64(32)) | number, found.first


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the word of each pair."""
    return (keys >> np.uint64(32)).astype(np.int64), (keys & _WORD).astype(np.int64)


@dataclass
class Model:
    """Counts of words as words and as the word before, for target (0) and background (1)."""

    words: Words
    single: np.ndarray
    before: np.ndarray
    mix: float = MIX

    def difference(self, keys: np.ndarray, target: np.ndarray, background: np.ndarray) -> np.ndarray:
        """Target loss minus background loss of each pair, given its counts."""
        prior, word = _split(keys)
        loss = []
        for side, count in enumerate((target, background)):
            total = self.single[side].sum()
            alone = (self.single[side][word] + 1) / (total + self.words.size)
            context = self.before[side][prior]
            share = np.where(context > 0, self.mix * count / np.maximum(context, 1) + (1 - self.mix) * alone, alone)
            loss.append(-np.log(share))
        return loss[0] - loss[1]


def _word_counts(batches):
    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for low, high in T.slices(batch.column(0)):
            found = T.words(batch.column(0).slice(low, high - low)).hashes
            every = np.concatenate((hashes, found))
            hashes, which = np.unique(every, return_inverse=True)
            counts = np.bincount(which, np.concatenate((counts, np.ones(len(found), np.int64))), len(hashes)).astype(np.int64)
            if len(hashes) > _HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["word", "n"])
                hashes, counts = hashes[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["word", "n"])


def vocabulary(texts: DataFrame, least: int = LEAST) -> Words:
    """All words (by hash) of a column of texts that occur at least ``least`` times."""
    counted = texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return Words(np.sort(counted.select("word").toArrow()["word"].to_numpy().view(np.uint64)))


def good_ids(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """``id`` of everything labelled good; a repeated id has its least label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull())
    once = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(column).cast("int")).alias("label"))
    return once.where("label = 1").select("id")


def _spot(name: str):
    """Place of an id in a bitmap; -1 without an id."""
    return F.coalesce(F.when(F.col(name).isNotNull(), F.pmod(F.xxhash64(name), F.lit(_BITS))), F.lit(-1))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of hashed ids, 8 MB however many there are."""
    spots = ids.select(_spot("id").alias("spot"))
    row = F.floor(F.col("spot") / _BITS_A_ROW).cast("int").alias("row")
    bits = np.zeros((_BITS // _BITS_A_ROW, _BITS_A_ROW // 8), np.uint8)
    for r in spots.groupBy(row).agg(F.bitmap_construct_agg(F.pmod("spot", F.lit(_BITS_A_ROW))).alias("bits")).collect():  # 2,048 rows at most
        bits[r.row] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits.ravel()


def _held(bits: np.ndarray, spots: pa.Array) -> np.ndarray:
    at = np.asarray(spots)
    return (at >= 0) & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)


class Good:
    """Tells the rows with a good id. Nearly all are told by bitmaps in place, the others by a join.

    The second bitmap has the ids of ``rows`` that the first holds though they aren't good. A row in the first alone is
    therefore good for sure; a row in both is looked up. While ids are few against 2**26 bits, hardly any row is in both; with very many
    all rows that the first holds are joined.
    """

    def __init__(self, rows: DataFrame, good: DataFrame):
        self.rows = rows.select("doc_id", "text", _spot("doc_id").alias("spot"))
        self.ids = stored(good)
        self.first = _bitmap(self.ids)
        first = self.first

        def taken(batches):
            for batch in batches:
                yield batch.select(["id"]).filter(pa.array(_held(first, batch.column("spot"))))

        ids = rows.where("doc_id is not null").select(F.col("doc_id").alias("id"), _spot("doc_id").alias("spot")).mapInArrow(taken, "id long")
        self.second = _bitmap(ids.join(self.ids, "id", "left_anti"))

    def marks(self):
        """A function from rows to their texts with ``good``: 1 for sure, else 0."""
        first, second = self.first, self.second

        def marks(batches):
            for batch in batches:
                sure = _held(first, batch.column("spot")) & ~_held(second, batch.column("spot"))
                yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(sure.astype(np.int32))], ["text", "good"])

        return marks

    def sure(self) -> DataFrame:
        marks = self.marks()

        def sure(batches):
            for batch in marks(batches):
                yield batch.select(["text"]).filter(pa.array(np.asarray(batch.column("good")) == 1))

        return self.rows.mapInArrow(sure, "text string")

    def checked(self) -> DataFrame:
        """Texts of the good rows that are not sure."""
        first, second = self.first, self.second

        def open_rows(batches):
            for batch in batches:
                both = _held(first, batch.column("spot")) & _held(second, batch.column("spot"))
                yield batch.select(["doc_id", "text"]).filter(pa.array(both))

        found = self.rows.mapInArrow(open_rows, "doc_id long, text string")
        return found.join(self.ids, F.col("doc_id") == F.col("id"), "left_semi").select("text")

    def texts(self) -> DataFrame:
        return self.sure().unionByName(self.checked())


def good_texts(rows: DataFrame, labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """The texts of ``rows`` whose id is labelled good; a repeated id has its least label."""
    return Good(rows, good_ids(labels, column, id_col)).texts()


def _packed(values: np.ndarray) -> bytes:
    """Numbers compressed byte place by byte place."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little") * np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed_steps(keys: np.ndarray) -> bytes:
    """Numbers in ascending order, as their differences."""
    return _packed(np.diff(keys, prepend=keys.dtype.type(0)))


def _unpacked_steps(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(_unpacked(data, kind), dtype=kind)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (T.mix(keys) % np.uint64(buckets)).astype(np.int32)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts keys together by bucket, each bucket's in the order they have, and the borders."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_COUNTS = "bucket int, keys binary, background binary, target binary"


def _count(words: Words, buckets: int):
    """Pair counts of a task, packed by bucket. Rows count for the background (``good`` 0), for both (1) or for the target (2)."""

    def flush(pieces):
        keys = np.concatenate([k for k, _ in pieces])
        good = np.concatenate([g for _, g in pieces])
        found, which = np.unique(keys, return_inverse=True)
        background = np.bincount(which[good < 2], minlength=len(found)).astype(np.uint32)
        target = np.bincount(which[good > 0], minlength=len(found)).astype(np.uint32)
        order, borders = _dealt(found, buckets)
        keys, *sides = (x[order] for x in (found, background, target))
        parts = [(b, slice(borders[b], borders[b + 1])) for b in range(buckets) if borders[b + 1] > borders[b]]
        rows = [(b, _packed_steps(keys[own]), *(_packed(x[own]) for x in sides)) for b, own in parts]
        yield _batch(rows, _COUNTS)

    def count(batches):
        pieces, size = [], 0
        for batch in batches:
            texts, good = batch.column("text"), np.asarray(batch.column("good"))
            for low, high in T.slices(texts):
                keys, first = words.pairs(texts.slice(low, high - low))
                pieces.append((keys, np.repeat(good[low:high].astype(np.int8), np.diff(first))))
                size += len(keys)
                if size > _BLOCK_WORDS:
                    yield from flush(pieces)
                    pieces, size = [], 0
        if pieces:
            yield from flush(pieces)

    return count


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _arrays(table) -> list[np.ndarray]:
    """Keys and counts of the rows, one after the other."""
    rows = table.to_pylist()
    keys = [_unpacked_steps(r["keys"]) for r in rows]
    sides = ([_unpacked(r[n], np.uint32) for r in rows] for n in ("background", "target"))
    return [np.concatenate([np.zeros(0, kind), *parts]) for kind, parts in zip((np.uint64, np.uint32, np.uint32), (keys, *sides), strict=True)]


def _merged(one: tuple, two: tuple) -> tuple:
    """Counts of two sets of pairs added up."""
    keys, which = np.unique(np.concatenate((one[0], two[0])), return_inverse=True)
    sides = (np.bincount(which, np.concatenate((a, b)), len(keys)).astype(np.uint32) for a, b in zip(one[1:], two[1:], strict=True))
    return keys, *sides


def _merge(batches):
    """All counts of a bucket in one row. Rows are unpacked one by one and merged with what is no larger."""
    for group in T.runs(batches, ["bucket"]):
        held: list[tuple] = []
        for batch in group.to_batches(max_chunksize=16):
            for low in range(batch.num_rows):
                held.append(tuple(_arrays(batch.slice(low, 1))))
                while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
                    held.append(_merged(held.pop(), held.pop()))
        while len(held) > 1:
            held.append(_merged(held.pop(), held.pop()))
        keys, total, good = held[0]
        yield _batch([(group.column("bucket")[0].as_py(), _packed_steps(keys), _packed(total), _packed(good))], _COUNTS)


def _singles(size: int):
    """Counts by word and by the word before, from the pairs of the merged buckets."""

    def singles(batches):
        out = np.zeros((4, size), np.int64)
        for batch in batches:
            keys, background, target = _arrays(batch)
            prior, word = _split(keys)
            for row, (part, weight) in enumerate(((word, target), (word, background), (prior, target), (prior, background))):
                out[row] += np.bincount(part, weight, size).astype(np.int64)
        seen = np.flatnonzero(out.any(axis=0))
        for low in range(0, len(seen), 1 << 18):
            some = seen[low : low + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in out)], ["word", "a", "b", "c", "d"])

    return singles


def _frequent(least: float):
    def frequent(batches):
        for batch in batches:
            keys, background, target = _arrays(batch)
            often = background >= least
            columns = (keys[often].view(np.int64), background[often].astype(np.int64), target[often].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "b", "t"])

    return frequent


_ROWS = "bucket int, kind int, block long, x binary, y binary, z binary"


def _ask(words: Words, hot: np.ndarray, hot_value: np.ndarray, buckets: int):
    """Sums over frequent pairs by document, and the other pairs packed by bucket."""

    def flush(block, pieces):
        ids = np.concatenate([i for i, _, _, _ in pieces])
        no_id = np.concatenate([m for _, m, _, _ in pieces])
        keys = np.concatenate([k for _, _, k, _ in pieces])
        counts = np.concatenate([np.diff(f) for _, _, _, f in pieces])
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        own = np.zeros(len(ids))
        if len(hot):
            place = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            often = hot[place] == keys
            own = np.bincount(owner[often], hot_value[place[often]], len(ids))
            keys, owner = keys[~often], owner[~often]
        rows = [(block % buckets, _OWN, block, np.where(no_id, -1, 1).astype(np.int64).tobytes() + ids.tobytes(), counts.astype(np.int64).tobytes(), own.tobytes())]
        # In order of the pairs, whose differences are small numbers; the document goes along with each.
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        order, borders = _dealt(keys, buckets)
        keys, owner = keys[order], owner[order]
        for b in np.flatnonzero(np.diff(borders)).tolist():
            own = slice(borders[b], borders[b + 1])
            rows.append((b, _ASK, block, _packed_steps(keys[own]), _packed(owner[own]), b""))
        for low in range(0, len(rows), 64):
            yield _batch(rows[low : low + 64], _ROWS)

    def ask(batches):
        part, turn = TaskContext.get().partitionId(), 0
        pieces, size = [], 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            number, none = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
            for low, high in T.slices(texts):
                pieces.append((number[low:high], none[low:high], *words.pairs(texts.slice(low, high - low))))
                size += len(pieces[-1][2])
                if size > _BLOCK_WORDS:
                    yield from flush((part << 24) + turn, pieces)
                    pieces, size, turn = [], 0, turn + 1
        if pieces:
            yield from flush((part << 24) + turn, pieces)

    return ask


def _look_up(model: Model):
    """Values of asked pairs from their bucket's counts, summed by document."""

    def look_up(batches):
        known, value, of = np.zeros(0, np.uint64), np.zeros(0), None
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(low, 64).to_pylist():
                    if r["kind"] == _TABLE:
                        known = _unpacked_steps(r["x"])
                        background, target = (_unpacked(r[c], np.uint32) for c in "yz")
                        value, of = model.difference(known, target, background), r["bucket"]
                    elif r["kind"] == _OWN:
                        rows.append((r["block"], _OWN, r["x"], r["y"], r["z"]))
                    else:
                        assert of == r["bucket"]
                        found = value[np.searchsorted(known, _unpacked_steps(r["x"]))]
                        owner = _unpacked(r["y"], np.int32)
                        sums, asked = np.bincount(owner, found), np.bincount(owner)
                        docs = np.flatnonzero(asked).astype(np.int32)
                        rows.append((r["block"], _ASK, _packed_steps(docs), sums[docs].astype(np.float32).tobytes(), b""))
                yield _batch(rows, "block long, kind int, x binary, y binary, z binary")

    return look_up


def _finish(batches):
    for group in T.runs(batches, ["block"]):
        rows = group.to_pylist()
        own = next(r for r in rows if r["kind"] == _OWN)
        marks, ids = np.frombuffer(own["x"], np.int64).reshape(2, -1)
        words, total = np.frombuffer(own["y"], np.int64), np.frombuffer(own["z"], np.float64).copy()
        # Partial sums are added in order of their bytes, so that reruns agree to the last bit.
        for docs, sums in sorted((r["x"], r["y"]) for r in rows if r["kind"] == _ASK):
            total[_unpacked_steps(docs, np.int32)] += np.frombuffer(sums, np.float32)
        score = np.where(words > 0, total / np.maximum(words, 1), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=marks < 0), pa.array(words), pa.array(score)], ["doc_id", "n_words", "score"])


def cross_entropy_difference(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", least: int = LEAST, mix: float = MIX, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, n_words, score``.

    Words that the target documents have fewer than ``least`` times are unknown. Null and empty texts have no
    words and score 0. Without target documents every word is unknown, and the target model knows no pair. Rows without an id are
    background like any other.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = Good(rows, good_ids(labels, label_col, id_col))
    known = vocabulary(good.texts(), least)
    marks, count = good.marks(), _count(known, buckets)
    checked = good.checked().withColumn("good", F.lit(2)).mapInArrow(count, _COUNTS)
    counted = good.rows.mapInArrow(lambda batches: count(marks(batches)), _COUNTS).unionByName(checked)
    tables = stored(counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge, _COUNTS))
    sums = tables.mapInArrow(_singles(known.size), "word long, a long, b long, c long, d long").groupBy("word").agg(*[F.sum(c).alias(c) for c in "abcd"])
    single, before = np.zeros((2, known.size)), np.zeros((2, known.size))
    found = sums.toArrow()  # one row per word of the vocabulary at most
    for out, names in ((single, "ab"), (before, "cd")):
        for side, name in enumerate(names):
            out[side, found["word"].to_numpy()] = found[name].to_numpy()
    model = Model(known, single, before, mix)
    least = max(single[1].sum() / FREQUENT, 1.0)
    often = tables.mapInArrow(_frequent(least), "k long, b long, t long").toPandas()  # FREQUENT rows at most
    hot = often.k.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)  # as unsigned numbers
    hot, often = hot[order], often.iloc[order]
    value = model.difference(hot, often.t.to_numpy(float), often.b.to_numpy(float))
    asked = rows.mapInArrow(_ask(known, hot, value, buckets), _ROWS)
    counts = tables.select("bucket", F.lit(_TABLE).alias("kind"), F.lit(-1).cast("long").alias("block"), F.col("keys").alias("x"), F.col("background").alias("y"), F.col("target").alias("z"))
    looked = (
        asked.unionByName(counts)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "kind")
        .mapInArrow(_look_up(model), "block long, kind int, x binary, y binary, z binary")
    )
    return looked.repartition(buckets, "block").sortWithinPartitions("block").mapInArrow(_finish, "doc_id long, n_words long, score double")
