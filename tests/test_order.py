"""Ranks, selection and pairs within reach over many partitions, and the covariance queries against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ensemble as E
from gridloom.operators import geodesic as J
from gridloom.operators import generate as G
from gridloom.operators.covariance import correlations
from gridloom.operators.order import numbered
from gridloom.plans import fitted
from gridloom.plans import views as V

SF = "/root/testdata/sf0.01"


def test_numbered(spark):
    """A key over many partitions, a null key, null values first, and numbers without keys."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(1)
        rows = [("hot", int(v)) for v in rng.permutation(500)] + [(None, 3), ("b", None), ("b", 1)]
        df = spark.createDataFrame(rows, "k string, v int").repartition(7)
        assert {(r.k, r.v): r.at for r in numbered(df, ["v"], "at", ["k"]).collect()} == {("hot", v): v for v in range(500)} | {(None, 3): 0, ("b", None): 0, ("b", 1): 1}
        assert [r.at for r in numbered(df.filter("k = 'hot'"), ["v"], "at").orderBy("v").collect()] == list(range(500))
        assert numbered(df.limit(0), ["v"], "at").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def median(pairs):
    """By the row rules: above half of all weight, at exactly a half, after the half."""
    pairs, half = sorted(pairs), sum(w for _, w in pairs) / 2
    heavy = [v for v, w in pairs if w > half]
    c = np.cumsum([w for _, w in pairs])
    middle = [(pairs[k][0] + pairs[k + 1][0]) / 2 for k in range(len(pairs) - 1) if abs(c[k] - half) < 1e-12]
    return heavy[0] if heavy else min(middle) if middle else min(v for (v, _), x in zip(pairs, c) if x > half)


def test_weighted_selection(spark):
    """One hot key over all partitions, ties of values, exact halves between slices, heavy values, nulls."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(2)
        groups = {"hot": [(float(v), float(w)) for v, w in zip(rng.integers(0, 300, 2000), rng.integers(0, 5, 2000))]}
        groups |= {f"g{k}": [(float(v), float(w)) for v, w in zip(rng.integers(0, 4, 6), rng.integers(0, 3, 6) + 0.5)] for k in range(40)}
        groups |= {"half": [(float(k), 1.0) for k in range(100)], "heavy": [(1.0, 1.0), (2.0, 9.0), (3.0, 2.0)], "one": [(4.0, 0.0)]}
        rows = [(k, v, w) for k, g in groups.items() for v, w in g] + [("hot", None, 1e9), ("gone", None, 1.0)]
        df = spark.createDataFrame(rows, "k string, value double, weight double").repartition(5)
        got = {r.k: r.value for r in E.weighted_median(df, ["k"]).collect()}
        del groups["one"]
        assert got.pop("one") is None
        assert got == {k: pytest.approx(median(g)) for k, g in groups.items()}
        found = {r.k: r.value for r in E.median_nearest(df, ["k"], "value").collect()}
        assert all(found[k] == sorted(v for v, _ in g)[round((len(g) - 1) * 0.5)] for k, g in groups.items()) and "gone" not in found
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("haversine", [False, True])
def test_near_pairs(spark, haversine):
    """Poles, the date line, both ends of the earth and cells without coordinates; the same as all pairs within reach."""
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 150))), rng.uniform(-180, 360, 150)))]
    rows += [(200, 90.0, 0.0), (201, 89.9, 180.0), (202, 10.0, 179.9), (203, 10.0, -179.9), (204, None, 1.0), (205, -90.0, 5.0), (206, 10.0, 179.9)]
    cells = spark.createDataFrame(rows, "cell_id long, lat double, lon double")
    every = J.near_pairs(cells, 50_000.0, haversine)
    for reach in (700.0, 4000.0):
        near = {(r.cell_i, r.cell_j): r.km for r in J.near_pairs(cells, reach, haversine).collect()}
        assert near == {(r.cell_i, r.cell_j): pytest.approx(r.km, abs=1e-9) for r in every.collect() if r.km <= reach}
    if not haversine:
        assert {(r.cell_i, r.cell_j) for r in every.collect()} == {(r.cell_i, r.cell_j) for r in J.geodist(cells).filter("km IS NOT NULL").collect()}


def best_radius(x, km, radii, folds):
    """The first local minimum of the cross-validated likelihood, and the localised covariance of all samples."""
    scores = []
    for radius in radii:
        total = 0.0
        for f in range(folds):
            out = np.arange(len(x)) % folds == f
            cov = np.cov(x[~out], rowvar=False) * correlations(km / radius)
            total += 0.5 * sum(np.linalg.slogdet(cov)[1] + v @ np.linalg.solve(cov, v) + len(cov) * np.log(2 * np.pi) for v in x[out]) if np.linalg.eigvalsh(cov)[0] > 0 else np.inf
        scores.append(total)
    at = next((k for k in range(len(radii) - 1) if scores[k + 1] > scores[k]), len(radii) - 1)
    return radii[at], np.cov(x, rowvar=False), np.cov(x, rowvar=False) * correlations(km / radii[at])


def samples(spark, keys, sample):
    """The samples of the covariance queries by key, in order, and the cells' distances."""
    mon = V.monthly(spark, SF).toPandas()
    mon["one"] = 1
    pairs = J.geodist(V.cells(spark, SF)).filter("cell_i < 5 AND cell_j < 5").collect()
    km = np.zeros((5, 5))
    for r in pairs:
        km[r.cell_i, r.cell_j] = r.km
    out = {}
    for key, part in mon.groupby(keys):
        part = part.pivot(index=sample, columns="cell_id", values="value")
        part = part - part.mean()
        out[key if not isinstance(key, tuple) else key[0]] = part.dropna().sort_index().to_numpy()
    return out, km


def test_covariance_queries(spark):
    """localized_covariance, its monthly form and correlate_noise on sf0.01, restated with numpy."""
    for name, keys, sample, folds in (("localized_covariance", ["one"], ["member", "year", "month"], 5), ("localized_covariance_monthly", ["month"], ["member", "year"], 4)):
        x, km = samples(spark, keys, sample)
        got = fitted.QUERIES[name](spark, SF).collect() if hasattr(fitted, "QUERIES") else getattr(fitted, name)(spark, SF).collect()
        assert len(got) == 25 * len(x)
        known = {k: best_radius(v, km, [1000.0, 2000.0, 4000.0, 6000.0, 8000.0], folds) for k, v in x.items()}
        for r in got:
            radius, cov, local = known[r.month if name.endswith("monthly") else 1]
            assert (r.radius, r["cov"], r["localized"]) == pytest.approx((radius, cov[r.cell_i, r.cell_j], local[r.cell_i, r.cell_j]), abs=1e-5)
    x, km = samples(spark, ["one"], ["member", "year", "month"])
    local = best_radius(x[1], km, [2000.0, 4000.0, 8000.0], 5)[2]
    keys = V.monthly(spark, SF).select(F.lit("m").alias("scenario"), F.col("member").alias("realisation"), (F.col("year") * 12 + F.col("month")).alias("t"), "cell_id").distinct()
    white = G.noise_table(keys, "7").toPandas().pivot(index=["scenario", "realisation", "t"], columns="cell_id", values="noise")
    coloured = white.to_numpy() @ np.linalg.cholesky(local).T
    found = fitted.correlate_noise(spark, SF).toPandas().pivot(index=["scenario", "realisation", "t"], columns="cell_id", values="noise")
    assert (found.index == white.index).all() and np.abs(found.to_numpy() - coloured).max() < 1e-5
