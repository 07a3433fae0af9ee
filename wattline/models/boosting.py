"""Boosted trees per series, many fits at once.

Spark cuts the features of every series into at most 255 bins once, at its quantiles, and stores the bins as blocks of
bytes, one row per chunk of a series. Every fit (a candidate on a fold, or on all rows) of every series is a
task of its own over these blocks, so cross-validation of all candidates is one job, and the
forest of a series doesn't depend on the other series of the table. A task holds one series: a grid has one row per
step, so that is some 60 bytes a step, and ``MAX_STEPS`` (119 years of hours) bounds it. Longer series
raise; ``trees.fit_trees`` spreads one model over the rows instead.

Trees grow best first: the leaf with the largest gain is split next, histograms are summed for the smaller child and
subtracted for the other. With early stopping the validation margins are kept up to date, and the fit ends ``patience`` rounds
after the best; its forest is the prefix up to there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.grid import step_of, time_of
from wattline.models.trees import SEED, Trees
from wattline.names import BY, DEMAND, TIME
from wattline.operators.chunks import CHUNK_STEPS, chunk_of
from wattline.operators.features import complete_rows
from wattline.sources.files import checkpoint_folder

BINS = 255
MAX_STEPS = 1 << 20
CHUNK = "_chunk"
_QUANTILES = [i / BINS for i in range(1, BINS)]
_ACCURACY = 10_000
_ROWS = 4096
#: Partitions per fit, so that two long fits seldom share one.
_SPREAD = 16

# One tree after the other: a leaf has feature -1 and points at itself.
FOREST = (
    "start double, roots array<int>, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, value array<double>, gain array<double>"
)


@dataclass
class Forest:
    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, row: Mapping) -> Forest:
        whole = {k: np.asarray(row[k], np.int32) for k in ("roots", "feature", "left", "right")}
        return cls(float(row["start"]), **whole, **{k: np.asarray(row[k], float) for k in ("threshold", "value", "gain")})

    def score(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of ``x``, all trees at once."""
        out = np.full(len(x), self.start)
        column = np.maximum(self.feature, 0)
        for low in range(0, len(x) if len(self.roots) else 0, _ROWS):
            part = x[low : low + _ROWS]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            while (self.feature[node] >= 0).any():
                goes_left = part[rows, column[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            out[low : low + len(part)] += self.value[node].sum(axis=1)
        return out


class _Leaf:
    __slots__ = ("node", "rows", "total", "sums", "counts", "depth", "gain", "feature", "bin")

    def __init__(self, node: int, rows: np.ndarray, total: float, depth: int) -> None:
        self.node, self.rows, self.total, self.depth = node, rows, total, depth
        self.sums = self.counts = None
        self.gain, self.feature, self.bin = 0.0, -1, -1


class _Booster:
    """One fit: bins of its rows, and the trees so far with thresholds as bins."""

    def __init__(self, codes: np.ndarray, target: np.ndarray, trees: Trees) -> None:
        # Bins of all features in one row: a feature has as many places as it has bins.
        self.width = codes.shape[1]
        sizes = codes.max(axis=0).astype(np.int64) + 1
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.owner = np.repeat(np.arange(self.width), sizes)
        self.places = codes.astype(np.int32) + self.first[:-1].astype(np.int32)
        self.codes, self.target, self.trees = codes, target, trees
        self.start = float(target.mean())
        self.margin = np.full(len(target), self.start)
        self.roots: list[int] = []
        self.feature: list[int] = []
        self.bin: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.gain: list[float] = []

    def _node(self) -> int:
        node = len(self.feature)
        for column, value in ((self.feature, -1), (self.bin, 0), (self.left, node), (self.right, node), (self.value, 0.0), (self.gain, 0.0)):
            column.append(value)
        return node

    def _histogram(self, leaf: _Leaf, slope: np.ndarray) -> None:
        flat, size = self.places[leaf.rows].ravel(), len(self.owner)
        leaf.sums = np.bincount(flat, weights=np.repeat(slope[leaf.rows], self.width), minlength=size)
        leaf.counts = np.bincount(flat, minlength=size).astype(float)

    def _best(self, leaf: _Leaf, allowed: np.ndarray) -> None:
        """The split with the largest gain, the first of equal ones."""
        n, least, l2 = len(leaf.rows), self.trees.min_rows, self.trees.l2
        sums, counts = (np.concatenate(([0.0], np.cumsum(x))) for x in (leaf.sums, leaf.counts))
        start = self.first[:-1][self.owner]
        sums, counts = sums[1:] - sums[start], counts[1:] - counts[start]
        rest = n - counts
        fits = allowed & (counts >= least) & (rest >= least) & (rest > 0) & (counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = np.where(fits, sums * sums / (counts + l2) + (leaf.total - sums) ** 2 / (rest + l2), 0.0)
        at = int(gains.argmax())
        leaf.feature = int(self.owner[at])
        leaf.bin = at - int(self.first[leaf.feature])
        leaf.gain = float(gains[at]) - leaf.total**2 / (n + l2)

    def grow(self, round_: int) -> None:
        """One more tree on the residuals."""
        trees, n = self.trees, len(self.target)
        chance = np.random.default_rng((SEED, round_))
        share = 1.0 if trees.feature_share == "all" else float(trees.feature_share)
        chosen = np.zeros(self.width, bool)
        chosen[chance.permutation(self.width)[: max(1, round(share * self.width))]] = True
        allowed = chosen[self.owner]
        slope = self.target - self.margin
        rows = np.arange(n) if trees.row_share >= 1.0 else np.sort(chance.permutation(n)[: max(1, round(trees.row_share * n))])
        root = _Leaf(self._node(), rows, float(slope[rows].sum()), 0)
        self.roots.append(root.node)
        most = trees.leaves or 2**trees.max_depth
        deepest = None if trees.leaves else trees.max_depth
        leaves = {root.node: root}
        self._histogram(root, slope)
        self._best(root, allowed)
        waiting = [(-root.gain, root.node)]
        while waiting and len(leaves) < most:
            cost, node = heapq.heappop(waiting)
            if cost >= -1e-9:
                break
            leaf = leaves.pop(node)
            low = self.codes[leaf.rows, leaf.feature] <= leaf.bin
            parts = (leaf.rows[low], leaf.rows[~low])
            children = [_Leaf(self._node(), part, float(slope[part].sum()), leaf.depth + 1) for part in parts]
            self.feature[node], self.bin[node], self.gain[node] = leaf.feature, leaf.bin, leaf.gain
            self.left[node], self.right[node] = (c.node for c in children)
            leaves |= {c.node: c for c in children}
            if len(leaves) < most and (deepest is None or leaf.depth + 1 < deepest):
                small, large = sorted(children, key=lambda c: len(c.rows))
                self._histogram(small, slope)
                large.sums, large.counts = leaf.sums - small.sums, leaf.counts - small.counts
                for child in children:
                    self._best(child, allowed)
                    heapq.heappush(waiting, (-child.gain, child.node))
            leaf.sums = leaf.counts = None
        for leaf in leaves.values():
            self.value[leaf.node] = trees.learning_rate * leaf.total / (len(leaf.rows) + trees.l2)
        if trees.row_share >= 1.0:
            for leaf in leaves.values():
                self.margin[leaf.rows] += self.value[leaf.node]
        else:
            self.margin += self.last_tree(self.codes)

    def last_tree(self, codes: np.ndarray) -> np.ndarray:
        """Values of the newest tree for some rows."""
        first = self.roots[-1]
        feature, bin_, left, right = (np.array(c[first:], np.int32) for c in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(codes), np.int32)
        rows = np.arange(len(codes))
        while (feature[node] >= 0).any():
            goes_left = codes[rows, np.maximum(feature[node], 0)] <= bin_[node]
            node = np.where(goes_left, left[node], right[node]) - first
        return np.array(self.value[first:])[node]

    def forest(self, rounds: int, edges: Sequence[np.ndarray]) -> Forest:
        """The first ``rounds`` trees with thresholds as feature values."""
        end = self.roots[rounds] if rounds < len(self.roots) else len(self.feature)
        feature = np.array(self.feature[:end], np.int32)
        threshold = np.array([edges[f][b] if f >= 0 else np.inf for f, b in zip(self.feature[:end], self.bin[:end], strict=True)], float)
        whole = [np.array(c[:end], np.int32) for c in (self.left, self.right)]
        return Forest(self.start, np.array(self.roots[:rounds], np.int32), feature, threshold, *whole, np.array(self.value[:end]), np.array(self.gain[:end]))


@dataclass
class Outcome:
    booster: _Booster
    rounds: int
    run: int
    margin: np.ndarray


def boost(codes: np.ndarray, target: np.ndarray, trees: Trees, held: tuple[np.ndarray, np.ndarray] | None = None, rounds: int | None = None) -> Outcome:
    """Fit; ``held`` (codes, target) stops boosting where the candidate has patience.

    ``margin`` has the predictions for ``held`` after the kept rounds, and ``run`` the rounds that were grown.
    """
    booster = _Booster(codes, target, trees)
    margin = np.full(len(held[1]) if held else 0, booster.start)
    best, error, kept = 0, np.inf, margin
    run = 0
    for run in range(1, (rounds or trees.rounds) + 1):
        booster.grow(run)
        if held is None:
            continue
        margin = margin + booster.last_tree(held[0])
        now = float(((held[1] - margin) ** 2).mean()) if len(margin) else 0.0
        if now < error or not trees.patience:
            best, error, kept = run, now, margin
        elif run - best >= trees.patience:
            break
    return Outcome(booster, run if held is None else best, run, kept)


# --- Spark side --------------------------------------------------------------------


def _keys(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities: both sides of a cogroup may stem from one table."""
    return df.toDF(*df.columns)


def _spread_over_chunks(model: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``model`` (a row or few per series), once for each chunk that the series has in ``rows``."""
    chunks = rows.groupBy(*by).agg(F.min(CHUNK).alias("_lo"), F.max(CHUNK).alias("_hi"))
    spread = model.join(chunks, list(by)).withColumn(CHUNK, F.explode(F.sequence("_lo", "_hi")))
    return fresh(spread.drop("_lo", "_hi"))


def _chunked(df: DataFrame, freq: str, time: str, chunk_steps: int) -> DataFrame:
    return df.withColumn(CHUNK, chunk_of(step_of(F.col(time), freq), chunk_steps))


def bin_edges(df: DataFrame, features: Sequence[str], *, by: Sequence[str] = BY) -> DataFrame:
    """At most 254 thresholds per series and feature: its quantiles, sketched while rows are read."""
    # One text instead of hundreds of literals per column, which the optimizer would walk through again and again.
    quantiles = F.split(F.lit(",".join(map(repr, _QUANTILES))), ",").cast("array<double>")
    cuts = [F.percentile_approx(F.col(c).cast("double"), quantiles, _ACCURACY).alias(f"_e{i}") for i, c in enumerate(features)]
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *cuts)
    edges = F.array(*[F.array_sort(F.array_distinct(f"_e{i}")) for i in range(len(features))])
    return found.select(*by, "n_rows", edges.alias("edges"))


def binned_blocks(
    df: DataFrame,
    features: Sequence[str],
    *,
    freq: str,
    target: str = DEMAND,
    by: Sequence[str] = BY,
    time: str = TIME,
    block: str | None = None,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """One row per chunk of a series: steps, bins, target and block of its rows as bytes, and the edges.

    ``df`` is read twice, so it should be a stored table. The result is checkpointed: every fit reads it.
    Rows without a feature or the target are left out.
    """
    rows = complete_rows(df, [*features, target])
    rows = rows.select(
        *by,
        step_of(F.col(time), freq).alias("_step"),
        (F.col(block) if block else F.lit(0)).cast("int").alias("_block"),
        F.col(target).cast("double").alias("_target"),
        *[F.col(c).cast("double").alias(c) for c in features],
        chunk_of(step_of(F.col(time), freq), chunk_steps).alias(CHUNK),
    )
    edges = _spread_over_chunks(bin_edges(rows, features, by=by), rows, by)
    names, keys = list(features), list(by)

    def pack(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*keys, CHUNK, "n_rows", "edges", "steps", "bins", "target", "blocks"])
        cuts = edges["edges"].iloc[0]
        rows = rows.sort_values("_step")
        bins = np.empty((len(rows), len(names)), np.uint8)
        for j, name in enumerate(names):
            bins[:, j] = np.searchsorted(np.asarray(cuts[j], float), rows[name].to_numpy(float), side="left")
        out = {k: [rows[k].iloc[0]] for k in [*keys, CHUNK]}
        out |= {"n_rows": [edges["n_rows"].iloc[0]], "edges": [[list(c) for c in cuts]]}
        out |= {"steps": [rows["_step"].to_numpy(np.int64).tobytes()], "bins": [bins.tobytes()]}
        out |= {"target": [rows["_target"].to_numpy(float).tobytes()], "blocks": [rows["_block"].to_numpy(np.int32).tobytes()]}
        return pd.DataFrame(out)

    schema = _keys(rows, [*keys, CHUNK]) + ", n_rows long, edges array<array<double>>, steps binary, bins binary, target binary, blocks binary"
    packed = rows.groupBy(*keys, CHUNK).cogroup(edges.groupBy(*keys, CHUNK)).applyInPandas(pack, schema)
    checkpoint_folder(df.sparkSession)
    return packed.checkpoint()


@dataclass
class _Series:
    """The rows of one series in order."""

    steps: np.ndarray
    codes: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    edges: list

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> _Series:
        n = int(pdf["n_rows"].iloc[0])
        if n > MAX_STEPS:
            raise ValueError(f"a series of {n} rows is longer than {MAX_STEPS} steps; fit_trees spreads a model over rows")
        pdf = pdf.sort_values(CHUNK)
        edges = [np.asarray(e, float) for e in pdf["edges"].iloc[0]]
        join = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in pdf[name]])
        codes = join("bins", np.uint8).reshape(-1, len(edges))
        return cls(join("steps", np.int64), codes, join("target", float), join("blocks", np.int32), edges)


def _each_fit(blocks: DataFrame, fits: DataFrame, on: Sequence[str], keys: Sequence[str]):
    """The blocks of every series once per fit, each fit in a partition of its own as far as hashing allows."""
    known = blocks.join(fits, list(on))
    n = fits.join(blocks.select(*on).distinct(), list(on)).count()
    return known.repartition(max(1, min(n * _SPREAD, 20_000)), *keys).groupBy(*keys)


def _all_fits(blocks: DataFrame, trees: Mapping[str, Trees], folds: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Every candidate and fold of every series."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(int(k)).alias("fold")) for m in trees for k in folds])
    return blocks.select(*by).distinct().withColumn("_fit", F.explode(pairs)).select(*by, "_fit.*")


def cv_forests(
    blocks: DataFrame,
    trees: Mapping[str, Trees],
    folds: Sequence[int],
    *,
    freq: str,
    rounds: int | None = None,
    target: str = DEMAND,
    by: Sequence[str] = BY,
    time: str = TIME,
) -> DataFrame:
    """Predictions of the validation blocks of all candidates and ``folds``, in one job.

    ``blocks`` comes from ``binned_blocks`` with the ``block`` of ``time_blocks``. The validation block decides when
    boosting stops where a candidate has patience. ``n_rounds`` were kept, ``n_run`` grown.
    """
    candidates = dict(trees)
    keys = [*by, "model", "fold"]
    fits = _all_fits(blocks, candidates, folds, by)
    at = len(by)

    def validate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data, fold = _Series.of(pdf), int(key[at + 1])
        seen, held = data.blocks < fold, data.blocks == fold
        done = boost(data.codes[seen], data.target[seen], candidates[key[at]], (data.codes[held], data.target[held]), rounds)
        out = pd.DataFrame({"_step": data.steps[held], target: data.target[held], "pred": done.margin})
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        return out.assign(n_rounds=done.rounds, n_run=done.run)[[*keys, "_step", target, "pred", "n_rounds", "n_run"]]

    schema = _keys(blocks, by) + f", model string, fold int, _step long, `{target}` double, pred double, n_rounds int, n_run int"
    scored = _each_fit(blocks, fits, by, keys).applyInPandas(validate, schema)
    return scored.withColumn(time, time_of(F.col("_step"), freq)).drop("_step")


def fit_forests(
    blocks: DataFrame,
    trees: Mapping[str, Trees],
    *,
    which: DataFrame | None = None,
    before: int | None = None,
    rounds: int | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """A forest per series and candidate: keys, ``model``, the arrays of ``FOREST`` and ``n_rows``.

    ``which`` (keys, ``model``) names the candidate of each series; otherwise every series gets all of them. With ``before``
    only rows of earlier blocks are used.
    """
    candidates = dict(trees)
    keys = [*by, "model"]
    fits = _all_fits(blocks, candidates, [0], by).drop("fold")
    if which is not None:
        fits = fits.join(which.select(*keys).distinct(), keys, "left_semi")
    at = len(by)
    columns = [c.split()[0] for c in FOREST.split(", ")]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = _Series.of(pdf)
        seen = slice(None) if before is None else data.blocks < before
        codes, target = data.codes[seen], data.target[seen]
        if not len(target):
            return pd.DataFrame(columns=[*keys, *columns, "n_rows"])
        done = boost(codes, target, candidates[key[at]], rounds=rounds)
        forest = done.booster.forest(done.rounds, data.edges)
        out = {**{k: [v] for k, v in zip(keys, key, strict=True)}, "start": [forest.start]}
        out |= {c: [getattr(forest, c)] for c in columns[1:]}
        return pd.DataFrame(out | {"n_rows": [len(target)]})

    schema = _keys(blocks, by) + f", model string, {FOREST}, n_rows long"
    return _each_fit(blocks, fits, by, keys).applyInPandas(fit, schema)


def predict_forests(
    df: DataFrame,
    forests: DataFrame,
    features: Sequence[str],
    *,
    freq: str,
    by: Sequence[str] = BY,
    time: str = TIME,
    output: str = "pred",
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Predictions by the forest of each row's own series, a chunk of a series at a time."""
    rows = _chunked(complete_rows(df, features), freq, time, chunk_steps)
    spread = _spread_over_chunks(forests.drop("n_rows"), rows, by)
    names, keys = list(features), [*by, CHUNK]

    def predict(rows: pd.DataFrame, forests: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(forests):
            return rows.iloc[:0].assign(**{output: np.zeros(0)}).drop(columns=CHUNK)
        forest = Forest.of(forests.iloc[0])
        return rows.assign(**{output: forest.score(rows[names].to_numpy(float))}).drop(columns=CHUNK)

    schema = T.StructType([*[f for f in rows.schema if f.name != CHUNK], T.StructField(output, T.DoubleType())])
    return rows.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(predict, schema)


def forest_importance(forests: DataFrame, features: Sequence[str], top: int = 15, *, by: Sequence[str] = BY) -> DataFrame:
    """The ``top`` features of each forest by their share of all gain, in ``rank`` order."""
    names = F.array(*[F.lit(c) for c in features])
    splits = forests.select(*by, "model", F.explode(F.arrays_zip("feature", "gain")).alias("s")).where("s.feature >= 0")
    sums = splits.groupBy(*by, "model", F.get(names, F.col("s.feature")).alias("feature")).agg(F.sum("s.gain").alias("gain"))
    forest = Window.partitionBy(*by, "model")
    shares = sums.withColumn("importance", F.col("gain") / F.sum("gain").over(forest))
    ranked = shares.withColumn("rank", F.row_number().over(forest.orderBy(F.desc("importance"), "feature")))
    return ranked.where(F.col("rank") <= top).drop("gain")


def rows_of(forest: Forest) -> Iterator[tuple[str, object]]:
    """The columns of ``FOREST`` for one forest."""
    for name in (c.split()[0] for c in FOREST.split(", ")):
        value = getattr(forest, name)
        yield name, value.tolist() if isinstance(value, np.ndarray) else value
