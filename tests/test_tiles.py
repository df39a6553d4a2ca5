"""Tiled matrices against numpy: factors, localised covariances and coloured noise, with tiles of a few cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import covariance as K
from gridloom.operators import fits as M
from gridloom.operators import generate as G
from gridloom.operators import tiles as T

N = 11


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, N)) @ (np.eye(N) + 0.3 * rng.standard_normal((N, N)))
    place = rng.uniform(0, 5000, N)
    return x, rng.uniform(0.5, 1.5, 40), np.abs(place[:, None] - place)


def tables(spark, x, w, km, reach=math.inf):
    """Cells are 100, 97, ..., so that they are numbered from the last; distances beyond `reach` are left out."""
    rows = spark.createDataFrame([(s, 100 - 3 * c, float(x[s, c]), float(w[s])) for s in range(len(x)) for c in range(N)], "sample_id long, cell_id long, value double, weight double")
    far = spark.createDataFrame([(100 - 3 * i, 100 - 3 * j, float(km[i, j])) for i in range(N) for j in range(N) if km[i, j] <= reach], "cell_i long, cell_j long, km double")
    return rows, far


def score(x, w, km, radius, folds):
    total = 0.0
    for f in range(folds):
        out = np.arange(len(x)) % folds == f
        cov = np.cov(x[~out], rowvar=False, aweights=w[~out]) * K.correlations(km / radius)
        try:
            np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            return math.inf
        own = np.einsum("s,si,sj->ij", w[out], x[out], x[out]) / w[out].sum()
        total += 0.5 * (N * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + np.trace(np.linalg.solve(cov, own))) * out.sum()
    return total


@pytest.mark.parametrize("size,samples", [(512, 1024), (4, 3)])
def test_localized_covariance_by_tiles(spark, data, size, samples, monkeypatch):
    monkeypatch.setattr(K, "SAMPLES", samples)
    x, w, km = data
    radii = [500.0, 1000.0, 2000.0, 4000.0, 1e5]
    rows, far = tables(spark, x, w, km, 2 * radii[3])
    expected = [score(x, w, km, r, 4) for r in radii[:4]]
    got = {r.radius: r.score for r in K.radius_scores(rows, far, radii[:4], 4, size=size).collect()}
    assert [got[r] for r in radii[:4]] == pytest.approx(expected)
    best = next((i for i in range(3) if expected[i + 1] > expected[i]), 3)
    full = np.cov(x, rowvar=False, aweights=w)
    rows, far = tables(spark, x, w, km)
    for r in K.localized_covariance(rows, far, radii[:4], 4, size=size).collect():
        i, j = (100 - r.cell_i) // 3, (100 - r.cell_j) // 3
        assert r.radius == radii[best] and r.cov == pytest.approx(full[i, j]) and r.localized == pytest.approx(full[i, j] * K.correlations(km[i, j] / radii[best]))
    assert K.localized_covariance(rows.limit(0), far, radii, 4).count() == 0


def test_keys_by_tiles(spark, data):
    x, w, km = data
    rows, far = tables(spark, x, w, km)
    other, _ = tables(spark, x[::-1] * 2, w, km)
    both = rows.withColumn("month", F.lit(1)).union(other.withColumn("month", F.lit(2)))
    got = {(r.month, r.radius): r.score for r in K.radius_scores(both, far, [800.0, 3000.0], 3, ["month"], size=5).collect()}
    for (month, radius), s in got.items():
        assert s == pytest.approx(score(x if month == 1 else 2 * x[::-1], w, km, radius, 3))
    assert len(got) == 4


@pytest.mark.parametrize("rank", [N, 6])
def test_factor_by_tiles(spark, data, rank):
    """Also of a singular matrix, whose factor has columns of zeros."""
    x = data[0][: rank + 1] if rank < N else data[0]
    full = np.cov(x, rowvar=False)
    cov = spark.createDataFrame([(i, j, float(full[i, j])) for i in range(N) for j in range(N)], "cell_i long, cell_j long, cov double")
    factor = K.covariance_factor(cov, size=3)
    root = np.zeros((N, N))
    for r in factor.collect():
        root[r.cell_i, r.cell_j] = r.value
    assert root @ root.T == pytest.approx(full, abs=1e-6) and not np.triu(root, 1).any()
    if rank == N:
        assert root == pytest.approx(np.linalg.cholesky(full))
    noise = np.random.default_rng(1).standard_normal((30, N))
    table = spark.createDataFrame([("s", k // 10, k % 10, i, float(noise[k, i])) for k in range(30) for i in range(N)], "scenario string, realisation long, t int, cell_id long, noise double")
    got = np.zeros((30, N))
    for r in G.correlate_noise(table, factor, size=4, samples=7).collect():
        got[r.realisation * 10 + r.t, r.cell_id] = r.noise
    assert got == pytest.approx(noise @ root.T)
    with pytest.raises(Exception, match="misses a cell"):
        G.correlate_noise(table.filter("NOT (t = 3 AND realisation = 1 AND cell_id = 5)"), factor, size=4).collect()


def test_negative_definite_raises(spark):
    cov = spark.createDataFrame([(i, j, [[1.0, 2.0], [2.0, 1.0]][i][j]) for i in range(2) for j in range(2)], "cell_i long, cell_j long, cov double")
    with pytest.raises(Exception, match="negative"):
        K.covariance_factor(cov, size=1).collect()


def test_inverse_lower():
    m = np.tril(np.random.default_rng(3).standard_normal((150, 150))) + 20 * np.eye(150)
    assert T.inverse_lower(m) @ m == pytest.approx(np.eye(150), abs=1e-12)


def test_first_local_minimum(spark):
    inf = math.inf
    found = lambda *scores: M.first_local_minimum(spark.createDataFrame([(float(k), s) for k, s in enumerate(scores)], "radius double, score double")).first().radius
    with pytest.warns(UserWarning):
        assert [found(5.0, 4.0, 3.0, 2.0, 3.0, 0.0), found(1.0, 0.0, 1.0, 2.0), found(1.0, 1.0, 1.0), found(inf, 1.0, 2.0), found(1.0, inf, 0.0)] == [3, 1, 2, 1, 0]
    for bad in ((inf, inf), (1.0, -inf), (None, math.nan)):
        with pytest.raises(ValueError):
            found(*bad)
    keyed = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), (None, 1.0, 3.0), (None, 2.0, 1.0)], "k string, radius double, score double")
    assert {tuple(r) for r in M.first_local_minimum(keyed, keys=["k"]).collect()} == {("a", 1.0, 2.0), (None, 2.0, 1.0)}
