"""Every query with SQL against DuckDB on sf0.001, and golden numbers of the functions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import ensemble as E
from gridloom.operators import fits as M
from gridloom.operators import generate as G
from gridloom.operators import grid as P
from gridloom.operators import harmonic as H
from gridloom.plans.registry import ORACLES, QUERIES, rounded

SF = "/root/testdata/sf0.001"


def split(rows):
    """Sorted by all but the floats, which are compared with a tolerance: rounding may go either way at a tie."""
    keyed = sorted(([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]) for r in rows)
    return [k for k, _ in keyed], [x for _, f in keyed for x in f]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(spark, duck, name, sf):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    keys, floats = split(tuple(r[c] for c in columns) for r in df.collect())
    other_keys, other_floats = split(found.fetchall())
    assert keys == other_keys and floats == pytest.approx(other_floats, abs=1e-5)


@pytest.mark.parametrize("name", ["ar_fit", "ar_recursion", "emulate_annual", "harmonic_fit", "harmonic_predict", "quality_scores_crps", "conditional_fit"])
def test_query_on_longer_series(spark, name):
    """On sf0.01, where every series has several lagged pairs and its years are whole."""
    sf, c = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    same(spark, c, name, sf)


@pytest.mark.parametrize("name", ["calc_anomaly", "global_mean_anomaly", "mask_and_stack", "closest_neighbors", "weighted_median", "linreg_fit", "ar_fit", "lowess", "noise_table", "ar_recursion", "density_weights", "weighted_covariance", "merge_predictor_tables", "lowess_pooled", "ar_order_scen_ens", "smooth_coefficients", "ar_recursion_monthly"])
def test_query(spark, duck, name):
    same(spark, duck, name, SF)


def test_rounding_at_ties(spark):
    """To the last bit as DuckDB rounds: halves of the last digit, whose doubles lie on either side of it, and what cannot be scaled."""
    x = [s * n / 2e6 for n in range(1, 400000, 194) for s in (1, -1)] + [0.0009975, 0.2512445, -1.2999924999999999, 0.0, 1e12 + 0.5, 1e305, -1e305, float("inf"), None]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    c = duckdb.connect()
    for digits in (2, 6):
        found = {r.i: r.x for r in rounded(df, digits).collect()}
        assert found == {i: c.execute(f"select round(?::double, {digits})", [v]).fetchone()[0] for i, v in enumerate(x)}
    assert rounded(df.select(F.lit(float("nan")).alias("x"))).filter("isnan(x)").count() == len(x)


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_golden_functions(spark):
    lon = [(-180.1,), (-180.0,), (-1.0,), (0.0,), (179.99,), (180.0,), (899.0,)]
    assert values(spark, lon, "x double", S.wrap_to_180(F.col("x"))) == pytest.approx([179.9, -180, -1, 0, 179.99, -180, 179])
    r = [(0.0,), (0.5,), (1.0,), (1.5,), (2.0,)]
    assert values(spark, r, "x double", S.gaspari_cohn(F.col("x"))) == pytest.approx([1, 0.68489583, 0.20833333, 0.01649306, 0], abs=1e-8)
    yj = [(0.0, 1.0), (1.0, 1.0), (0.0, 0.0), (1.0, 0.0), (-1.0, 1.0), (-1.0, 2.0)]
    assert values(spark, yj, "x double, l double", S.yeo_johnson(F.col("x"), F.col("l"))) == pytest.approx([0, 1, 0, 0.6931471805599453, -1, -0.6931471805599453])
    assert values(spark, yj, "x double, l double", S.yeo_johnson_inverse(S.yeo_johnson(F.col("x"), F.col("l")), F.col("l"))) == pytest.approx([x for x, _ in yj])


def test_golden_fits(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, 1.0, 3.0, 7.0), (1, 2.0, 4.0, 8.0)], "k int, a double, b double, y double")
    r = M.linreg_fit(df, ["k"], ["a", "b"], "y").first()
    assert (r.intercept, r.b_a, r.b_b) == pytest.approx((-2, -3, 4))
    for w, expected in (([0.1, 0.2, 0.3, 0.2, 0.2], 3), ([0.1, 0.1, 0.1, 0.1, 1.0], 5), ([1.0] * 4, 2.5)):
        rows = spark.createDataFrame([(1, float(i + 1), x) for i, x in enumerate(w)], "k int, value double, weight double")
        assert E.weighted_median(rows, ["k"]).first().value == pytest.approx(expected)
    e = spark.createDataFrame([(1, t, 0.0) for t in range(6)], "cell_id int, t int, noise double")
    p = spark.createDataFrame([(1, 1.0, 0.5)], "cell_id int, intercept double, coeff double")
    got = sorted((r.t, r.x) for r in G.ar_recursion(e, p, ["cell_id"], buffer=1).collect())
    assert [x for _, x in got][:4] == pytest.approx([0, 1, 1.5, 1.75])
    scored = lambda v: spark.createDataFrame(list(enumerate(map(float, v))), "radius long, score double")
    assert [M.first_local_minimum(scored(v)).first().radius for v in ([5, 4, 3, 2, 3, 0], [1, 0, 1, 2], [1, 1, 1], [float("inf"), 1, 2])] == [3, 1, 2, 1]


def test_guards(spark):
    df = spark.createDataFrame([("historical", "a", 2000, 1, 1.0), ("scen", "b", 2010, 1, 1.0)], "scenario string, member string, year int, cell_id int, value double")
    with pytest.raises(ValueError, match="member is missing"):
        E.calc_anomaly(df, 1999, 2001)
    with pytest.raises(ValueError, match="empty"):
        E.calc_anomaly(df, 1900, 1901)


def test_closest_neighbors_by_cubes(spark):
    """All edges give what all pairs give: crowded and lonely cells, poles, both sides of the date line, equal places."""
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(40, 44, 60), rng.uniform(5, 9, 60)))]
    rows += [(100, 90.0, 0.0), (101, -90.0, 13.0), (102, 10.0, 179.9), (103, 10.0, -179.9), (104, 10.0, 180.0), (105, 10.0, -180.0), (106, None, 1.0)]
    df = spark.createDataFrame(rows, "cell_id long, lat double, lon double")
    every = sorted(map(tuple, P.closest_neighbors(df, 5, edge=2.0).collect()))
    assert len(every) == 5 * (len(rows) - 1)
    assert sorted(map(tuple, P.closest_neighbors(df, 5, edge=0.02).collect())) == every
    assert P.closest_neighbors(df.filter("false"), 5).count() == 0
    assert P.closest_neighbors(df.filter("cell_id < 3"), 5, edge=0.5).count() == 9


def test_weighted_covariance(spark):
    """Against numpy where samples are whole; a missing value leaves its sample out of that cell's pairs only."""
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(50, 4)), rng.uniform(0.5, 2, 50)
    rows = [(s, c, float(x[s, c]), float(w[s])) for s in range(50) for c in range(4)]
    df = spark.createDataFrame(rows, "sample_id long, cell_id long, value double, weight double")
    got = {(r.cell_i, r.cell_j): r.cov for r in E.weighted_covariance(df).collect()}
    full = np.cov(x.T, aweights=w)
    assert len(got) == 16 and all(got[i, j] == pytest.approx(full[i, j]) for i, j in got)
    gap = df.withColumn("value", F.when((F.col("sample_id") > 0) | (F.col("cell_id") > 0), F.col("value")))
    got = {(r.cell_i, r.cell_j): r.cov for r in E.weighted_covariance(gap, block=3).collect()}
    part = np.cov(x[1:].T, aweights=w[1:])
    assert got[1, 2] == pytest.approx(full[1, 2]) and got[0, 3] == pytest.approx(part[0, 3]) and got[3, 0] == pytest.approx(part[0, 3])


def test_density_weights(spark):
    """Small blocks and two predictors against all pairs, with a far outlier and a null."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(60, 2)), [[40.0, -3.0]]])
    inverse = np.linalg.inv(np.cov(x.T) * len(x) ** (-2 / 6))
    gap = x[:, None] - x[None]
    w = 1 / np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", gap, inverse, gap)).sum(axis=1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(99, None, 1.0)], "sample_id long, a double, b double")
    got = {r.sample_id: r.weight for r in E.density_weights(df, ["a", "b"], block=7).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(list(w / w.sum())) and len(got) == len(x)


def test_lowess_pooled(spark):
    """Without robust rounds, pooled members give the fit of their means; a part of the rows gives the same."""
    rng = np.random.default_rng(7)
    y = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(1, float(t), float(v)) for t in range(20) for v in y[t]], "k int, x double, y double")
    means = df.groupBy("k", "x").agg(F.avg("y").alias("y"))
    expected = {r.x: r.smooth for r in M.lowess(means, ["k"], "x", "y", 8).collect()}
    for found in (M.lowess(df, ["k"], "x", "y", 8, pooled=True), M.lowess(df, ["k"], "x", "y", frac=0.4), M.lowess(means, ["k"], "x", "y", frac=0.4)):
        assert {r.x: r.smooth for r in found.collect()} == pytest.approx(expected)
    with pytest.raises(ValueError, match="exactly one"):
        M.lowess(df, ["k"], "x", "y", 8, frac=0.4)


def test_harmonic(spark):
    """A cycle of two harmonics is found again without noise, and the order chosen with noise is that of a direct fit."""
    rng = np.random.default_rng(0)
    rows, cell_2 = [], []
    for year in range(30):
        y = float(rng.normal(10, 2))
        for m in range(1, 13):
            cycle = y + (0.3 * y + 1) * np.cos(np.pi * (m - 1) / 6) + (0.1 * y - 2) * np.sin(np.pi * (m - 1) / 3)
            rows.append((1, year, m, y, float(cycle)))
            cell_2.append((y, m, float(cycle + rng.normal(0, 0.5))))
            rows.append((2, year, m, *[cell_2[-1][i] for i in (0, 2)]))
    df = spark.createDataFrame(rows, "cell_id long, year int, month int, yearly double, value double")
    fit = H.harmonic_fit(df)
    found = {r.cell_id: r for r in fit.collect()}
    assert found[1].order == 2 and found[1].coeffs == pytest.approx([0.3, 1, 0, 0, 0, 0, 0.1, -2], abs=1e-6)
    y, m, v = (np.array(c) for c in zip(*cell_2))
    scores = []
    for k in range(1, 7):
        x = H.design(y, m, k)
        left = v - y - x @ np.linalg.lstsq(x, v - y, rcond=None)[0]
        scores.append(len(v) * np.log(np.mean(left**2)) + 4 * k * np.log(len(v)))
    assert found[2].order == next((k for k in range(1, 6) if scores[k] >= scores[k - 1]), 6)
    both = H.harmonic_predict(df.filter("cell_id = 1"), fit).collect()
    assert len(both) == 360 and all(abs(r.predicted - r.value) < 1e-6 for r in both)
    assert H.harmonic_fit(df.filter("false")).count() == 0
