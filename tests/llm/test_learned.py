import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wattline.llm import grams, lm, quality, toxicity

import cases

GOOD = "the of and to in is that it for was on are as with at by this be from or".split()


def _prose(rng, n=60):
    return " ".join(rng.choice(GOOD) + rng.choice(["", "", "ing", "ed"]) for _ in range(n)).capitalize() + "."


def _junk(rng, n=60):
    return " ".join(rng.choice(GOOD).upper() + rng.choice(["!!", "###", "%%%"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    texts = [_junk(rng) if i % 4 == 0 else _prose(rng) for i in range(400)]
    labels = [(i, int(i % 4 != 0)) for i in range(0, 400, 2)] + [(3, None), (None, 1), (9999, 1)]
    return cases.frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"), texts


def test_quality_rejects_junk_and_keeps_prose(corpus):
    docs, labels, _ = corpus
    rows = quality.selected(docs, labels)[2].collect()
    assert {r.doc_id for r in rows if not r.kept} == set(range(0, 400, 4))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_quality_weights_equal_plain_python(corpus):
    docs, labels, texts = corpus
    model, weighed = quality.fit(docs, labels)
    good = {i for i in range(0, 400, 2) if i % 4}
    raw, target = Counter(), Counter()
    per = []
    for i, t in enumerate(texts):
        own, _ = grams.buckets(pa.array([t]))
        per.append(own)
        raw.update(own.tolist())
        if i in good:
            target.update(own.tolist())
    b = grams.BUCKETS
    n_raw, n_target = sum(raw.values()) + b, sum(target.values()) + b
    got = {r.doc_id: r.log_weight for r in weighed.collect()}
    for i in (0, 1, 7, 399):
        want = sum(math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in per[i].tolist())
        assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("k", [0, 1, 57, 400, 999])
def test_gumbel_top_k_takes_the_k_largest_keys(corpus, k):
    docs, labels, _ = corpus
    rows = quality.selected(docs, labels, k=k, seed=3)[2].collect()
    keys = sorted((r.key for r in rows), reverse=True)
    assert sorted((r.key for r in rows if r.kept), reverse=True) == keys[:k]


def test_gumbel_noise_samples_in_proportion():
    ids = np.arange(200_000)
    noise = quality.gumbel(ids).reshape(-1, 4) + np.log([1, 2, 3, 4])
    assert np.allclose(np.bincount(noise.argmax(1), minlength=4) / 50_000, [0.1, 0.2, 0.3, 0.4], atol=0.01)


def test_kth_largest_with_ties(spark):
    values = [1.0, 2.0, 2.0, 2.0, 5.0, -3.5, 1e300, -1e300, 0.1, 0.1 + 1e-17]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(rows, "x", k) == sorted(values, reverse=True)[k - 1]


def test_models_stand_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1, 1), (5, 0, 0), (13, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for docs, own in ((cases.frame(spark), labels), (cases.frame(spark), none), (cases.empty(spark), none)):
        n = docs.count()
        assert quality.selected(docs, own)[2].count() == n
        assert quality.keep_good(docs, own).columns == docs.columns
        scored = toxicity.score(docs, toxicity.fit(docs, own)).collect()
        assert len(scored) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
        out = lm.cross_entropy_difference(docs, own).collect()
        assert len(out) == n and all(math.isfinite(r.score) for r in out)
        assert all(r.score == 0 for r in out if r.n_words == 0)


def _toxic(rng, i):
    words = [rng.choice(GOOD) for _ in range(40)]
    insult, group = i % 2, (i // 2) % 2
    if insult:
        words[5] = "blorg"
    if group:
        words[25] = "grupo"
    return " ".join(words), insult & group


def test_machine_learns_pairs_on_held_out_rows(spark):
    rng = random.Random(8)
    made = [_toxic(rng, i) for i in range(1200)]
    docs = cases.frame(spark, [t for t, _ in made])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(made)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == made[r.doc_id][1] for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(8)
    made = [_toxic(rng, i) for i in range(300)]
    docs = cases.frame(spark, [t for t, _ in made])
    out = []
    for flip in (0, 1):
        labels = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, (_, y) in enumerate(made)]
        out.append(sorted(toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()))
    assert out[0] == out[1]


def test_margin_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = toxicity.Machine(np.arange(9, dtype=np.uint64), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    place, borders = np.array([0, 3, 7, 2, 8]), np.array([0, 3, 3, 5])
    want = []
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        own = place[a:b]
        pairs = sum(machine.vectors[i] @ machine.vectors[j] for x, i in enumerate(own) for j in own[x + 1 :])
        want.append(0.3 + machine.weights[own].sum() + pairs)
    assert np.allclose(machine.margins(place, borders), want)


def test_cross_entropy_difference_equals_plain_python(corpus, spark):
    docs, labels, texts = corpus
    good = {i for i in range(0, 400, 2) if i % 4}
    words = [cases.WORD.findall(t.lower()) for t in texts]
    seen = Counter(w for i in good for w in words[i])
    known = {w for w, n in seen.items() if n >= lm.LEAST}
    coded = [[w if w in known else None for w in ws] for ws in words]
    sides = []
    for own in (good, range(400)):
        pair, single, before = Counter(), Counter(), Counter()
        for i in own:
            for a, b in zip(["<s>", *coded[i]], coded[i]):
                pair[a, b] += 1
                single[b] += 1
                before[a] += 1
        sides.append((pair, single, before))
    got = {r.doc_id: (r.n_words, r.score) for r in lm.cross_entropy_difference(docs, labels).collect()}
    size = len(known) + 2
    for i in (0, 1, 2, 5, 398):
        total = 0.0
        for a, b in zip(["<s>", *coded[i]], coded[i]):
            loss = []
            for pair, single, before in sides:
                alone = (single[b] + 1) / (sum(single.values()) + size)
                loss.append(-math.log(lm.MIX * pair[a, b] / before[a] + (1 - lm.MIX) * alone if before[a] else alone))
            total += loss[0] - loss[1]
        assert got[i][0] == len(words[i]) and got[i][1] == pytest.approx(total / len(words[i]), abs=1e-5)


def test_frequent_pairs_and_others_agree(corpus, monkeypatch):
    docs, labels, _ = corpus
    out = []
    for often in (1, 20_000):
        monkeypatch.setattr(lm, "FREQUENT", often)
        out.append({r.doc_id: r.score for r in lm.cross_entropy_difference(docs, labels).collect()})
    assert out[0] == pytest.approx(out[1], abs=1e-5)


def test_all_labelled_rows_and_words_count(spark):
    """More labelled documents than the samples of the classifiers have, and more words than 16 bits can number."""
    n = quality.SAMPLE + 3_000
    texts = [" ".join(f"w{i % 1500 * 50 + k}" for k in range(50)) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    good = lm.good_texts(docs, labels, "quality")
    assert good.count() == n and len(lm.vocabulary(good).known) == 75_000
    # All rows are target rows: both models are the same, so every score is exactly 0.
    assert all(r.n_words == 50 and r.score == 0 for r in lm.cross_entropy_difference(docs, labels).collect())


def test_good_texts_are_those_of_good_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c d"), (1, "a b"), (1, "e f"), (2, "g h"), (3, "i"), (-4, "j")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (None, 1), (3, None), (-4, 1)], "doc_id long, quality int")
    assert sorted(r.text for r in lm.good_texts(docs, labels, "quality").collect()) == ["a b", "e f", "j"]


def test_good_rows_are_told_though_the_bitmaps_are_crowded(spark, monkeypatch):
    """Small bitmaps: many ids are in the first one by chance, and some good ones in the second."""
    monkeypatch.setattr(lm, "_BITS", 1 << 15)
    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "int(id % 3 = 0) as quality")
    good = lm.Good(docs, lm.good_ids(labels, "quality"))
    sure, checked = ([r.text for r in part.collect()] for part in (good.sure(), good.checked()))
    assert sure and checked and sorted(sure + checked) == sorted(f"w{i}" for i in range(0, n, 3))


def test_terms_that_count_only_in_pairs(spark):
    """The label says whether exactly one of two words is there: neither says anything alone."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"word{rng.randrange(300)}" for _ in range(20)] + ["insulting"] * a + ["groupname"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    machine = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(frame, machine).where("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == labels[r.doc_id][1] for r in rows) > 0.95 * len(rows)
