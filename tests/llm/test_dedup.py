import random

import numpy as np
import pytest

from wattline.llm import dedup, text
from wattline.llm.graph import components

import cases


@pytest.mark.parametrize("threshold", [80, 85])
def test_equals_all_pairs_on_awkward_rows(spark, threshold):
    got = dedup.near_duplicates(cases.frame(spark), threshold).collect()
    known = [r for r in cases.frame(spark).select("doc_id", "text").collect() if r.doc_id is not None]
    sets = [(r.doc_id, cases.shingles(r.text)) for r in known]
    want = cases.components(sets, threshold)
    assert len(got) == len(cases.TEXTS) + 3
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(dict(sets)[r.doc_id]), want[r.doc_id] == r.doc_id)


def test_group_cut_into_parts_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART_DOCS", 7)
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(80)]
    texts = []
    for _ in range(70):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(80)] = f"v{rng.randrange(9999)}"
        texts.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(cases.frame(spark, texts), 85).collect()}
    assert got == cases.components([(i, cases.shingles(t)) for i, t in enumerate(texts)], 85)
    assert 1 < len(set(got.values())) < 70


def test_drop_keeps_one_row_of_each_group(spark):
    docs = cases.frame(spark)
    out = dedup.drop_duplicates(docs, 80)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    kept = {r.doc_id for r in dedup.near_duplicates(docs, 80).where("kept and doc_id is not null").collect()}
    # Of the two rows without an id one is a copy of another row, the other has no text.
    assert sorted(i for i in ids if i is not None) == sorted(kept) and ids.count(None) == 1


def test_rows_link_by_text_whatever_their_ids(spark):
    """Two unrelated texts with one id stay both; copies without an id, or with a repeated one, go."""
    other = " ".join(f"other{i}" for i in range(60))
    third = " ".join(f"third{i}" for i in range(60))
    rows = [(1, cases.BASE), (1, other), (2, other), (None, third), (None, third), (None, cases.BASE), (7, third.upper()), (9, ""), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    out = {r.place for r in dedup.drop_duplicates(docs).collect()}
    texts = [(rows[k][1] or "").lower() for k in out]
    assert sorted(t for t in texts if t) == sorted({cases.BASE, other, third})
    assert {2, 6} <= out  # ids of their own come first
    assert len(out & {7, 8}) == 1 and 9 in out


def test_empty_table(spark):
    assert dedup.near_duplicates(cases.empty(spark)).collect() == []
    assert dedup.drop_duplicates(cases.empty(spark)).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    values = np.concatenate((shared, a, shared, b))
    keys = dedup.band_keys(values, np.array([0, 800, 1600]), 2000, rows=1)
    assert abs((keys[0] == keys[1]).mean() - 0.6) < 0.05


def test_bands_hold_the_stated_miss():
    for t in (80, 85):
        assert (1 - (t / 100) ** dedup.ROWS) ** dedup.bands_for(t) <= dedup.MISS


def test_components_of_a_long_path_and_null_ends(spark):
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, 400), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(121)}, 400: 400, 500: 400}


def test_shingles_count_as_words_do():
    import pyarrow as pa

    texts = [t for t in cases.TEXTS]
    for limit in (1 << 20, 64):
        sizes = []
        column = pa.array(texts)
        for low, high in text.slices(column, limit):
            _, borders = text.distinct(*text.shingles(text.words(column.slice(low, high - low))))
            sizes += np.diff(borders).tolist()
        assert sizes == [len(cases.shingles(t)) for t in texts]
