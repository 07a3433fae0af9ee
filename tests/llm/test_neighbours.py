import numpy as np
import pytest

from wattline.llm import neighbours


def _plain(rows, queries, count):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q, v in queries:
        v = np.array(v, float)
        cos = (x * v).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum()))
        own = sorted((-c, int(i)) for i, c in zip(ids, cos, strict=True) if i != q)
        out[q] = own[:count]
    return out


def test_all_probes_equal_brute_force_with_ties_and_scale(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 24)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[3].tolist()) for i in range(40)] + [(2000, (2 * base[4]).tolist())]
    frame = spark.createDataFrame([(*r, "b", 1) for r in rows], "vec_id long, embedding array<double>, bucket string, ids int")
    queries = [r for r in rows if r[0] % 10 == 3 or r[0] == 2000]
    got = {}
    for r in neighbours.nearest(frame, frame.where("vec_id % 10 = 3 or vec_id = 2000"), tables=2, probes=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = _plain(rows, queries, 5)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [v for _, v, _ in sorted(found)] == [i for _, i in want[q]]
        assert [s for _, _, s in sorted(found)] == pytest.approx([-c for c, _ in want[q]], abs=1e-12)


def test_unusable_vectors_and_small_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 0.5]), (2, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(frame, frame).collect())
    assert got == [(1, 1, 2), (2, 1, 1)]
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).collect() == []


def test_recall_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, frame.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = _plain(rows, [r for r in rows if r[0] % 50 == 0], 5)
    hits = sum(len(got[q] & {i for _, i in found}) for q, found in want.items())
    assert hits / (5 * len(want)) >= 0.9


def test_rotation_keeps_lengths_and_fills_up():
    x = np.random.default_rng(2).normal(size=(20, 24))
    assert np.allclose((neighbours.rotate(x, 3) ** 2).sum(1), (x * x).sum(1))
    assert neighbours.rotate(x, 3).shape == (20, 32)


def test_scaled_copies_and_repeated_ids_do_not_hide_neighbours(spark):
    rng = np.random.default_rng(5)
    v, far = rng.normal(size=8), rng.normal(size=(8, 8))
    scaled = [(100 - k, (2.0**k * v).tolist()) for k in range(30)]
    own = [(1, (v + 0.01 * rng.normal(size=8)).tolist()) for _ in range(12)]
    repeated = [(2, (far[0] + 0.01 * rng.normal(size=8)).tolist()) for _ in range(12)]
    others = [(10 + k, w.tolist()) for k, w in enumerate(far)]
    for rows, query, want in (
        ([(0, v.tolist()), *scaled], 0, [71, 72, 73, 74, 75]),
        (own + others, 1, None),
        (repeated + others, 10, None),
    ):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = neighbours.nearest(frame, frame.where(f"vec_id = {query}").limit(1), tables=2, probes=16)
        found = [r.vec_id for r in got.where("rank <= 5").orderBy("rank").collect()]
        assert len(set(found)) == 5 and query not in found
        assert want is None or found == want


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 6))
    factor = [1e300, 1e-300, 1.0, 1e-160, 1e160]
    scaled = [(i, (x * factor[i % 5]).tolist()) for i, x in enumerate(v)]
    want = _plain(list(enumerate(v)), list(enumerate(v)), 5)
    frame = spark.createDataFrame(scaled, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, frame, tables=2, probes=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [i for i, _ in found] == [i for _, i in want[q]]
        assert [s for _, s in found] == pytest.approx([-c for c, _ in want[q]], abs=1e-12)
