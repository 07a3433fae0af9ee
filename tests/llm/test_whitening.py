import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import whitening
from wattline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long, whitened double, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 0.5, "t") for i, v in rows], SCHEMA)


def plain(vectors, count):
    """Integers, component variances and covariance with numpy's own solver."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    c = x - x.mean(axis=0)
    values, parts = np.linalg.eigh(c.T @ c / len(x))
    order = np.argsort(-values)[:count]
    return x, c, values[order], parts[:, order], values.sum()


def test_components_equal_a_plain_solver():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 17, 64):
        a = rng.standard_normal((size, 3 * size))
        v = a @ a.T / size
        values, parts = whitening.leading_components(v, min(size, 32))
        want = np.linalg.eigvalsh(v)[::-1][: len(values)]
        assert np.allclose(values, want, rtol=1e-12)
        assert np.allclose(v @ parts, parts * values, atol=1e-11 * want[0])
        assert np.allclose(parts.T @ parts, np.eye(len(values)), atol=1e-12)


@pytest.mark.parametrize("values", [[5, 5, 5, 5], [4, 4, 1, 1], [1e8, 1, 1e-4, 0], [3, 3 - 1e-9, 2, 2], list(range(40, 0, -1))])
def test_equal_close_and_tiny_eigenvalues(values):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = q @ np.diag(np.array(values, float)) @ q.T
    found, parts = whitening.leading_components((v + v.T) / 2, len(values))
    assert np.allclose(found, sorted(values, reverse=True), rtol=1e-10, atol=1e-13 * max(values))
    assert np.allclose(parts.T @ parts, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(v @ parts - parts * found) < 1e-12 * max(values)


def test_polar_factor_is_orthogonal():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    values, parts = np.linalg.eigh(a)
    assert np.allclose(whitening.polar(a), parts @ np.diag(np.sign(values)) @ parts.T, atol=1e-11)


def check(rows, vectors, count):
    x, c, values, parts, trace = plain(vectors, count)
    n, sums = len(x), x.sum(axis=0)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == n
    table = np.array([[got[i][k]["whitened"] for k in range(1, count + 1)] for i in sorted(got)])
    for i, place in zip(sorted(got), range(n), strict=True):
        assert len(got[i]) == count
        assert {r["n"] for r in got[i].values()} == {n}
        assert {r["deviation"] for r in got[i].values()} == {int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[place], sums, strict=True)))}
    want = c @ parts / np.sqrt(values)
    signs = np.sign((table * want).sum(axis=0))
    assert np.allclose(table * signs, want, atol=1e-7)
    assert np.allclose([got[min(got)][k]["explained"] for k in range(1, count + 1)], values / trace, rtol=1e-9)
    assert np.abs(np.cov(table.T, bias=True) - np.eye(count)).max() < 1e-9
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_query_equals_a_plain_version(spark, sf_dir):
    rows = QUERIES["op13_whitening"](spark, sf_dir).collect()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    check(rows, [v["embedding"] for v in vectors], 32)


def test_unusable_vectors_stay_out(spark):
    rng = np.random.default_rng(6)
    good = [[float(np.float32(a)) for a in row] for row in rng.standard_normal((40, 5))]
    rows = list(enumerate(good)) + [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf")] + [0.0] * 4), (94, [1.0, 2.0]), (95, [])]
    got = whitening.whiten(frame(spark, rows)).collect()
    check(got, good, 5)
    assert [f.name for f in whitening.whiten(frame(spark, rows)).schema][:2] == ["vec_id", "component"]


def test_repeated_and_null_ids_are_rows(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((20, 3)).tolist()
    rows = [(7, v) for v in vectors[:10]] + [(None, v) for v in vectors[10:]]
    got = whitening.whiten(frame(spark, rows).repartition(3))
    assert {(r["vec_id"], r["count"]) for r in got.groupBy("vec_id").count().collect()} == {(7, 30), (None, 30)}


def test_no_variance_no_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    # one of three dimensions varies, another follows it
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]))
    assert line.select("component").distinct().collect() == [(1,)]
    assert line.agg(F.max(F.abs(F.col("explained") - 1))).first()[0] < 1e-12


def test_large_numbers_stay_exact():
    x = np.array([[2**31, 5], [0, 7]], np.int64)
    sums = (2**31, 12)
    assert whitening._deviations(x, sums, 2).tolist() == [2**62 + 4, 2**62 + 4]
    with pytest.raises(OverflowError):
        whitening._deviations(x * 4, (2**33, 48), 2)
