"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: runs of word characters (A-Z as a-z), and the first four and five
bytes of longer ones, which inflected forms share. Besides a weight for each term the
model has a short vector for each, whose products weigh pairs: an insult and the mention of a
group can count for more together than apart.

The machine is trained on a bounded sample of labelled documents. Terms that are in fewer than ``RARE`` of
them, or whose chi-square with the label is below ``CHI_SQUARE``, play no part, nor do any beyond the best ``TERMS``. Of the ``FREQUENT`` terms
that most documents of the sample have, those also count that tell labels apart in a pair only: the chi-square of having both
is at least ``PAIR_SQUARE`` and twice that of either. Scoring covers all documents and whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import text as T
from wattline.llm.grams import tokens
from wattline.llm.quality import best_cut, labelled_sample
from wattline.llm.store import stored

SAMPLE = 20_000
FACTORS = 4
EPOCHS = 12
STEPS = 1_500
RARE = 2
CHI_SQUARE = 15.0
TERMS = 20_000
FREQUENT = 256
PAIR_SQUARE = 60.0
BEGINNINGS = (4, 5)
RATE = 0.1
DECAY = 2e-4
FOLDS = 5
_BATCH = 256
_SALTS = T.seeds(len(BEGINNINGS), 17)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each text and their borders: words, and beginnings of longer words."""
    found = tokens(T.lowered(texts))
    word = np.flatnonzero(T.WORD_BYTE[found.data[found.starts]]) if len(found.starts) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), found.counts)[word]
    values, owners = [found.hashes[word]], [owner]
    starts, sizes = found.starts[word], (found.ends - found.starts)[word]
    for n, salt in zip(BEGINNINGS, _SALTS, strict=True):
        longer = np.flatnonzero(sizes > n)
        values.append(T.mix(T.span_hashes(found.data, starts[longer], starts[longer] + n) ^ salt))
        owners.append(owner[longer])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return T.distinct(np.concatenate(values)[order], np.searchsorted(owner[order], np.arange(len(texts) + 1)))


@dataclass
class Machine:
    """Known terms in order of hash, a weight and a vector for each, and a constant."""

    known: np.ndarray
    constant: float
    weights: np.ndarray
    vectors: np.ndarray

    def places(self, values: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known ones among term sets, and their borders."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
        place = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        hit = self.known[place] == values
        return place[hit], np.concatenate(([0], np.cumsum(hit)))[borders]

    def margins(self, place: np.ndarray, borders: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        n = len(borders) - 1
        out = self.constant + np.bincount(owner, self.weights[place], n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[place, f]
            out += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """Chance of label 1 for each text; a text without known terms gets that of the constant."""
        out = np.zeros(len(texts))
        for low, high in T.slices(texts):
            margin = self.margins(*self.places(*terms(texts.slice(low, high - low))))
            out[low:high] = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
        return out


def train(known: np.ndarray, place: np.ndarray, borders: np.ndarray, labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 0) -> Machine:
    """Logistic loss, adaptive steps, mini-batches in a fixed random order, ``STEPS`` steps at least.

    ``place`` has the places among the ``known`` terms of each document's terms. With
    labels of one kind only, the score is the smoothed share of label 1.
    """
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    rng = np.random.default_rng(seed)
    machine = Machine(known, float(np.log(share / (1 - share))), np.zeros(len(known)), rng.normal(0, 0.01, (len(known), factors)))
    if not 0 < labels.sum() < len(labels) or not len(known):
        return Machine(known[:0], machine.constant, machine.weights[:0], machine.vectors[:0])
    squares_w, squares_v, square_0 = np.full(len(known), 1e-8), np.full((len(known), factors), 1e-8), 1e-8
    for _ in range(max(epochs, math.ceil(STEPS * _BATCH / len(labels)))):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), _BATCH):
            rows = order[at : at + _BATCH]
            sizes = borders[rows + 1] - borders[rows]
            own = place[np.repeat(borders[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            inner = np.concatenate(([0], np.cumsum(sizes)))
            error = 1 / (1 + np.exp(-np.clip(machine.margins(own, inner), -35, 35))) - labels[rows]
            owner = np.repeat(np.arange(len(rows)), sizes)
            touched, local = np.unique(own, return_inverse=True)
            step = error.sum() / len(rows)
            square_0 += step * step
            machine.constant -= RATE * step / np.sqrt(square_0)
            slope = np.bincount(local, error[owner], len(touched)) / len(rows) + DECAY * machine.weights[touched]
            squares_w[touched] += slope * slope
            old = machine.vectors[own]
            machine.weights[touched] -= RATE * slope / np.sqrt(squares_w[touched])
            for f in range(factors):
                v = old[:, f]
                total = np.bincount(owner, v, len(rows))[owner]
                slope = np.bincount(local, error[owner] * (total - v), len(touched)) / len(rows) + DECAY * machine.vectors[touched, f]
                squares_v[touched, f] += slope * slope
                machine.vectors[touched, f] -= 0.2 * RATE * slope / np.sqrt(squares_v[touched, f])
    # An even chance lies where labels are told apart best.
    machine.constant -= best_cut(machine.margins(place, borders), labels, balanced=False)
    return machine


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    """Rows that no label is learned from: crc32 of the id as text leaves 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % folds == 0, F.lit(True))


def _term_counts(batches):
    """Documents and documents with label 1 by term, and in the row without a term altogether."""
    held = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    documents = ones = 0
    for batch in batches:
        texts, label = batch.column("text"), np.asarray(batch.column("label"))
        documents, ones = documents + len(label), ones + int(label.sum())
        for low, high in T.slices(texts):
            values, borders = terms(texts.slice(low, high - low))
            known, which = np.unique(np.concatenate((held[0], values)), return_inverse=True)
            sides = ((held[1], np.ones(len(values), np.int64)), (held[2], np.repeat(label[low:high], np.diff(borders))))
            held = [known, *(np.bincount(which, np.concatenate(side), len(known)).astype(np.int64) for side in sides)]
    columns = [pa.array([None, *held[0].view(np.int64).tolist()], pa.int64()), pa.array([documents, *held[1].tolist()], pa.int64()), pa.array([ones, *held[2].tolist()], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["term", "seen", "ones"])


def _selected_terms(rows: DataFrame) -> np.ndarray:
    """Hashes of the terms that tell labels apart, in order."""
    counts = stored(rows.mapInArrow(_term_counts, "term long, seen long, ones long").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("ones").alias("ones")))
    total = counts.where("term is null").first()
    n, share = (total.seen, (total.ones + 0.5) / (total.seen + 1)) if total else (0, 0.5)
    spread = F.col("seen") * share * (1 - share) * F.greatest(1 - F.col("seen") / max(n, 1), F.lit(1e-3))
    square = F.pow(F.col("ones") - F.col("seen") * share, 2) / spread
    best = counts.where(F.col("term").isNotNull() & (F.col("seen") >= RARE) & (square >= CHI_SQUARE))
    top = best.orderBy(F.desc(square), "term").limit(TERMS).select("term").toPandas()
    alone = top.term.to_numpy(np.int64).view(np.uint64)
    return np.union1d(alone, _terms_of_pairs(rows, counts, n, share))


def _chi_square(seen: np.ndarray, ones: np.ndarray, n: int, share: float) -> np.ndarray:
    spread = seen * share * (1 - share) * np.maximum(1 - seen / max(n, 1), 1e-3)
    return np.divide((ones - seen * share) ** 2, spread, out=np.zeros(spread.shape), where=spread > 0)


def _terms_of_pairs(rows: DataFrame, counts: DataFrame, n: int, share: float) -> np.ndarray:
    """Hashes of frequent terms that tell labels apart together with another, and not alone."""
    often = counts.where(F.col("term").isNotNull() & (F.col("seen") >= RARE) & (F.col("seen") < n)).orderBy(F.desc("seen"), "term")
    often = often.limit(FREQUENT).toPandas()
    known = np.sort(often.term.to_numpy(np.int64).view(np.uint64))
    machine = Machine(known, 0.0, np.zeros(len(known)), np.zeros((len(known), 0)))

    def together(batches):
        both = np.zeros((2, len(known), len(known)))
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for low, high in T.slices(batch.column("text")):
                place, borders = machine.places(*terms(batch.column("text").slice(low, high - low)))
                has = np.zeros((high - low, len(known)), np.float32)
                has[np.repeat(np.arange(high - low), np.diff(borders)), place] = 1
                both[0] += has.T @ has
                both[1] += has.T @ (has * label[low:high, None].astype(np.float32))
        i, j = np.nonzero(both[0])
        sums = (both[k][i, j].astype(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), *sums)], ["i", "j", "seen", "ones"])

    found = rows.mapInArrow(together, "i int, j int, seen long, ones long").groupBy("i", "j").agg(F.sum("seen").alias("seen"), F.sum("ones").alias("ones"))
    cells = found.toPandas()  # FREQUENT squared rows at most
    both = np.zeros((2, len(known), len(known)))
    both[:, cells.i, cells.j] = cells.seen, cells.ones
    square = _chi_square(*both, n, share)
    alone = np.diag(square)
    paired = (square >= PAIR_SQUARE) & (square >= 2 * np.maximum(alone[:, None], alone[None, :])) & (both[0] >= RARE)
    return known[paired.any(axis=0)]


def _placed(known: np.ndarray):
    """Places of each document's known terms."""
    machine = Machine(known, 0.0, np.zeros(len(known)), np.zeros((len(known), 0)))

    def placed(batches):
        for batch in batches:
            for low, high in T.slices(batch.column("text")):
                place, borders = machine.places(*terms(batch.column("text").slice(low, high - low)))
                sets = [place[a:b].astype(np.int32).tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]
                rest = [batch.column(c).slice(low, high - low) for c in ("doc_id", "label")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], ["doc_id", "label", "places"])

    return placed


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine trained on at most ``size`` labelled documents that aren't held out.

    Terms are counted and chosen where the documents are; the driver gets the chosen ones' places in the sample.
    """
    sample = stored(labelled_sample(labels.where(~held_out(id_col)), label_col, size, id_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).drop("label_id")
    known = _selected_terms(rows)
    got = rows.mapInArrow(_placed(known), "doc_id long, label int, places binary").toPandas()
    got = got.sort_values(["doc_id", "places"]).drop_duplicates("doc_id")
    sets = [np.frombuffer(x, np.int32) for x in got.places]
    borders = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
    return train(known, np.concatenate([*sets, np.zeros(0, np.int32)]).astype(np.int64), borders, got.label.to_numpy(float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``; null counts as the empty text."""

    def work(batches):
        for batch in batches:
            value = machine.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
