import numpy as np
import pandas as pd
import pytest

from marginalia.llm import whitening
from marginalia.llm.queries import op11_embedding_whitening
from marginalia.llm.whitening import compressed, jacobi, merged, whitened_vectors

DDL = "vec_id long, embedding array<float>, label int, x long, block long, n long, k int, w int"


def brute(vectors):
    """(deviations, eigenvalues, eigenvectors as columns) by the covariance in whole numbers."""
    x = np.floor(64 * np.stack([np.asarray(v, dtype=np.float32).astype(float) for v in vectors])).astype(np.int64) + 1_000_000
    n = len(x)
    c = n * x - x.sum(axis=0)
    e, v = np.linalg.eigh((c / n).T @ (c / n) / n)
    return (c * c).sum(axis=1), e[::-1], v[:, ::-1], c / n


def check(rows, vectors, ids, k):
    deviation, e, axes, centred = brute(vectors)
    assert len(rows) == len(ids) * k
    at = {(r["vec_id"], r["component"]): r for r in rows}
    for j in range(k):
        got = np.array([at[i, j + 1]["whitened"] for i in ids])
        want = centred @ axes[:, j] / np.sqrt(e[j])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert abs(at[ids[0], j + 1]["explained"] / (e[j] / e.sum()) - 1) < 1e-9
    assert [at[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert {r["n"] for r in rows} == {len(ids)} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_whole_table(spark, sf, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    t = pd.read_parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    check(op11_embedding_whitening(spark, f"/root/testdata/sf{sf}").collect(), list(t.embedding), t.vec_id.tolist(), 32)


def test_many_blocks_equal_one(spark, monkeypatch):
    """Triangles of many tasks, compressed in levels, give the same as one."""
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 6)) * [9, 5, 3, 2, 1, 0.5]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), *[0] * 6) for i, v in enumerate(x)], DDL).repartition(29)
    check(whitened_vectors(df).collect(), list(x), list(range(300)), 6)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 2 + [(None, [0.0] * 4)]
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0]), (92, [float("nan"), 0.0, 0.0, 1.0]), (93, [float("inf"), 0.0, 0.0, 1.0]), (94, [1.0, 2.0]), (95, [])]
    got = whitened_vectors(spark.createDataFrame([(i, v, *[0] * 6) for i, v in good + bad], DDL)).collect()
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {len(good)}
    deviation, *_ = brute([v for _, v in good])
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation.tolist())
    assert sum(r["vec_id"] is None for r in got) == 4 and got[0]["identity_error"] < 1e-9


def test_components_without_variance(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0, float(i % 5)], *[0] * 6) for i in range(60)]
    got = {(r["vec_id"], r["component"]): r for r in whitened_vectors(spark.createDataFrame(rows, DDL)).collect()}
    assert all(got[5, k]["whitened"] is not None for k in (1, 2)) and all(got[5, k]["whitened"] is None and got[5, k]["explained"] < 1e-12 for k in (3, 4))
    assert got[5, 1]["identity_error"] < 1e-9
    one = whitened_vectors(spark.createDataFrame([(1, [1.0, 2.0], *[0] * 6)], DDL)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    assert whitened_vectors(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("d", [1, 2, 5, 64, 101])
def test_jacobi_against_numpy(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(3 * d, d)) * np.logspace(0, -6, d)
    sizes, axes = jacobi(compressed(a))
    assert np.allclose(sizes, np.linalg.svd(a, compute_uv=False), rtol=1e-10, atol=0)
    assert np.abs(axes @ axes.T - np.eye(d)).max() < 1e-12
    assert np.abs((a @ axes.T / sizes).T @ (a @ axes.T / sizes) - np.eye(d)).max() < 1e-9


def test_merged_moments_of_shifted_blocks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) + 1e6
    n, mean, m = merged((len(b), b.mean(axis=0), (b - b.mean(axis=0)).T @ (b - b.mean(axis=0))) for b in np.array_split(x, 7))
    assert n == 500 and np.allclose(mean, x.mean(axis=0), rtol=1e-15) and np.allclose(m / n, np.cov(x.T, bias=True), rtol=1e-8)
