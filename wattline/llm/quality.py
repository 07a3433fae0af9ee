"""Quality classifier by importance resampling.

A generative model of hashed n-grams is fitted to target text (documents labelled good) and one
to the raw text (all documents). A document's importance is the ratio of its likelihoods
under the two. Documents are sampled without replacement in proportion to importance by Gumbel
top-k: the ``k`` with the largest log-importance plus Gumbel noise.

Log-importance is taken per n-gram and scaled to a common length, so that a long text isn't
judged by its length. ``k`` is the number of documents whose importance is on the good side of
the cut that best separates labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import text as T
from wattline.llm.grams import BUCKETS, buckets
from wattline.llm.store import stored

SAMPLE = 20_000
LENGTH = 100
_NO_ID = -1


def labelled_sample(labels: DataFrame, column: str, size: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """At most ``size`` labelled ids, chosen by a hash of the id; a repeated id counts once, by its least label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull())
    once = known.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min(F.col(column).cast("int")).alias("label"))
    return once.orderBy(F.xxhash64("label_id"), "label_id").limit(size)


@dataclass
class Importance:
    """Log-ratio of the two models by bucket, and the cut on the scaled log-importance."""

    ratio: np.ndarray
    cut: float = -np.inf

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-importance and number of n-grams of each text; no n-grams, no importance either way."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for low, high in T.slices(texts):
            bucket, owner = buckets(texts.slice(low, high - low), len(self.ratio))
            total[low:high] = np.bincount(owner, self.ratio[bucket], high - low)
            count[low:high] = np.bincount(owner, minlength=high - low)
        return total, count


def scaled(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    return LENGTH * total / np.maximum(count, 1)


def gumbel(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """Gumbel noise that depends on the id alone."""
    bits = T.mix(T.mix(ids.astype(np.int64).view(np.uint64)) + np.uint64(seed)) >> np.uint64(11)
    return -np.log(-np.log((bits + 0.5) / 2.0**53))


def _sums(batches):
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for batch in batches:
        texts, label = batch.column("text"), np.asarray(batch.column("label").fill_null(-1))
        for low, high in T.slices(texts):
            bucket, owner = buckets(texts.slice(low, high - low))
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[label[low:high][owner] == 1], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen].astype(np.int64)), pa.array(good[seen].astype(np.int64))], ["bucket", "raw", "good"])


def _with_labels(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids, texts and labels; the sample has at most ``SAMPLE`` rows, so it is broadcast."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left").drop("label_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[Importance, DataFrame]:
    """The two models and the cut, and every document's ``doc_id, log_weight, n_grams, label``.

    Counts of the raw model cover all documents. Labels come from at most ``size`` documents.
    Without labels of both kinds there is no cut, and every document is on its good side.
    """
    sample = stored(labelled_sample(labels, label_col, size, id_col))
    rows = _with_labels(docs, sample, id_col, text_col)
    summed = rows.select("text", "label").mapInArrow(_sums, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in summed.collect():  # one row per bucket at most
        raw[r.bucket] += r.raw
        good[r.bucket] += r.good
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum()) if good.sum() > BUCKETS else np.zeros(BUCKETS)
    model = Importance(ratio)

    def weigh(batches):
        for batch in batches:
            total, count = model.weigh(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(count), batch.column("label")], ["doc_id", "log_weight", "n_grams", "label"])

    weighed = stored(rows.mapInArrow(weigh, "doc_id long, log_weight double, n_grams long, label int"))
    known = weighed.where("label is not null").select("log_weight", "n_grams", "label").toPandas()  # the bounded sample
    value, label = scaled(known.log_weight.to_numpy(), known.n_grams.to_numpy()), known.label.to_numpy()
    if 0 < label.sum() < len(label):
        model.cut = best_cut(value, label)
    return model, weighed


def best_cut(value: np.ndarray, label: np.ndarray, balanced: bool = True) -> float:
    """The middle of the widest stretch where accuracy is best, each label counting the same or each row."""
    order = np.argsort(value, kind="stable")
    v, y = value[order], label[order]
    zeros, ones = ((y == 0).sum(), (y == 1).sum()) if balanced else (len(y), len(y))
    below = np.concatenate(([0], np.cumsum(y == 0))) / max(zeros, 1)
    over = np.concatenate(([0], np.cumsum(y == 1))) / max(ones, 1)
    score = (below + over[-1] - over)[1:-1]
    gap = np.where(score >= score.max() - 1e-12, v[1:] - v[:-1], -1)
    at = int(np.argmax(gap))
    return float((v[at] + v[at + 1]) / 2)


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest value of a column of finite doubles: the range is cut in 4,096, over and over.

    Only counts leave the executors. Ends when one value is left, or no double lies between the borders.
    """
    low, high, size = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not size or k <= 0:
        return np.inf
    if k >= size:
        return low
    above = 0  # values over ``high``
    while low < high:
        width = (high - low) / 4096
        step = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(4095)).cast("int")
        inside = rows.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        steps = inside.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for s in sorted(steps, key=lambda s: -s.step):
            if above + s.n >= k:
                break
            above += s.n
        if (s.low, s.high) == (low, high):
            return high
        low, high = s.low, s.high
    return low


def selected(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[Importance, float, DataFrame]:
    """Model, the least key that is kept, and per row ``doc_id, log_weight, n_grams, key, kept``."""
    model, weighed = fit(docs, labels, label_col, id_col=id_col, text_col=text_col)
    weight = F.col("log_weight") * LENGTH / F.greatest("n_grams", F.lit(1))

    def keys(batches):
        for batch in batches:
            noise = gumbel(np.asarray(batch.column("doc_id").fill_null(_NO_ID)), seed)
            value = scaled(np.asarray(batch.column("log_weight")), np.asarray(batch.column("n_grams")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value + noise)], [*batch.schema.names, "key"])

    keyed = stored(weighed.drop("label").mapInArrow(keys, "doc_id long, log_weight double, n_grams long, key double"))
    if k is None:
        k = keyed.where(weight >= F.lit(model.cut)).count()
    least = kth_largest(keyed, "key", k)
    return model, least, keyed.withColumn("kept", F.col("key") >= F.lit(least))


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the sampling rejects.

    Null and empty texts have importance one in either model and are kept or not by their
    noise and the cut. Rows with equal keys at the border all stay. Rows with equal ids share their noise.
    """
    model, least, _ = selected(docs, labels, k, seed, label_col, id_col, text_col)
    at, named = docs.columns.index(text_col), docs.columns.index(id_col)

    def keep(batches):
        for batch in batches:
            ids = np.asarray(batch.column(named).cast(pa.int64()).fill_null(_NO_ID))
            key = scaled(*model.weigh(batch.column(at))) + gumbel(ids, seed)
            yield batch.filter(pa.array(key >= least))

    return docs.mapInArrow(keep, docs.schema)
